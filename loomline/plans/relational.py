"""Tenant-scoped lists, counts and row changes. tenant = nation, user = customer, provider = supplier, model = part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators.purge import Purge
from ..operators.ranks import Ranked
from ..operators.shared import shared_path
from ..sources.store import Store
from ..sources.tables import table
from .catalogue import query

_USERS = "select c_custkey as id, c_nationkey as tenant_id, c_name as name, c_mktsegment as segment, case when c_acctbal < 0 then timestamp '2024-01-01' end as deleted_at from customer"
_MODELS = "select p_partkey as id, case when p_size > 10 then p_partkey % 25 end as tenant_id, p_partkey % (select count(*) from supplier) as provider_id, p_name as name, p_type as kind, p_size > 5 as status from part"


def users(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, F.expr("timestamp '2024-01-01'")).alias("deleted_at"))


def models(spark, sf):
    n = table(spark, sf, "supplier").count()
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_partkey") % 25).alias("tenant_id"), (F.col("p_partkey") % n).alias("provider_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") > 5).alias("status"))


@query(f"with u as ({_USERS}), s as (select * from u where tenant_id = 7 and deleted_at is null) select id, name, segment, (select count(*) from s) as total from s order by id desc limit 20 offset 10")
def tenant_list_page(spark, sf):
    """A page of a tenant's users with their total number: newest first."""
    scope = R.TenantScope(users(spark, sf), 7)
    rows = scope.df.orderBy(F.desc("id")).offset(10).limit(20)
    return rows.crossJoin(scope.count()).select("id", "name", "segment", F.col("n").alias("total"))


@query(f"with u as ({_USERS}) select -1 as id, count(*) as total from u where tenant_id = 7 and deleted_at is null")
def tenant_list_past_the_end(spark, sf):
    """A page past the end still says how many rows there are."""
    return R.TenantScope(users(spark, sf), 7).page(1000, 200, "id", keep_total=True).select(F.coalesce("id", F.lit(-1)).alias("id"), "total")


@query(f"with u as ({_USERS}) select id, name from u where tenant_id = 7 and deleted_at is null order by name, id limit 5 offset 5")
def tenant_list_second_page(spark, sf):
    return R.TenantScope(users(spark, sf), 7).page(2, 5, "name", "id").select("id", "name")


@query(f"with u as ({_USERS}) select id, name, rank, total from (select id, name, row_number() over (order by name, id) as rank, count(*) over () as total from u where deleted_at is null) where rank between 1001 and 1040")
def users_deep_page(spark, sf):
    """A page far down a list: ranks by ranges of the order, so that no task carries the rows before it."""
    ranked = Ranked(users(spark, sf).filter("deleted_at is null").select("id", "name"), "name", "id")
    return ranked.page(26, 40).select("id", "name", "rank", F.lit(ranked.total).cast("long").alias("total"))


@query(f"with m as ({_MODELS}) select id, coalesce(tenant_id, -1) as tenant_id, name from m where tenant_id = 3 or tenant_id is null")
def tenant_or_public_models(spark, sf):
    return R.TenantScope(models(spark, sf), 3, include_public=True).df.select("id", F.coalesce("tenant_id", F.lit(-1).cast("long")).alias("tenant_id"), "name")


@query(f"with u as ({_USERS}) select id, name from u where tenant_id = 5 and deleted_at is null and segment = 'BUILDING'")
def dynamic_filters(spark, sf):
    """Filters that are None, empty or on unknown columns don't filter."""
    return R.TenantScope(users(spark, sf), 5).where(segment="BUILDING", name=None, nothing="x").where_set(name="").df.select("id", "name")


@query(f"with m as ({_MODELS}) select id, provider_id from m where tenant_id = 4 and not status")
def filter_by_false(spark, sf):
    """False is a value to filter by, unlike None."""
    return R.TenantScope(models(spark, sf), 4).where(status=False, kind=None).df.select("id", "provider_id")


@query(f"with u as ({_USERS}) select id, name from u where tenant_id = (select min(tenant_id) from u) and deleted_at is null and id = (select max(id) from u where tenant_id = (select min(tenant_id) from u) and deleted_at is null)")
def point_lookup(spark, sf):
    u = users(spark, sf)
    tenant = u.agg(F.min("tenant_id")).first()[0]
    scope = R.TenantScope(u, tenant)
    return scope.get("id", scope.df.agg(F.max("id")).first()[0]).select("id", "name")


@query(f"with u as ({_USERS}) select tenant_id, count(*) as n from u where deleted_at is null group by tenant_id")
def users_per_tenant(spark, sf):
    return users(spark, sf).filter("deleted_at is null").groupBy("tenant_id").agg(F.count("*").alias("n"))


@query("select source as kb, case when n_chars < 100 then 'failed' else 'completed' end as status, count(*) as n from documents group by all")
def documents_by_status(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(F.col("source").alias("kb"), F.when(F.col("n_chars") < 100, "failed").otherwise("completed").alias("status")).agg(F.count("*").alias("n"))


@query("select source as kb, greatest(count(*) - 40, 0) as left_over, (coalesce(max(case when lang = 'es' then n_chars end), 0) + 1)::bigint as next_size from documents group by source")
def clamped_counters(spark, sf):
    """Counters that never go below zero, and a sum that takes null as zero."""
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("kb")).agg(F.count("*").alias("n"), F.max(F.when(F.col("lang") == "es", F.col("n_chars"))).alias("m"))
    return d.select("kb", S.clamped_subtract(F.col("n"), F.lit(40)).cast("long").alias("left_over"), S.null_safe_add(F.col("m"), F.lit(1)).cast("long").alias("next_size"))


@query(f"with u as ({_USERS}) select id, name, coalesce(case when id % 2 = 0 then upper(segment) end, segment) as segment from u")
def patch_merge(spark, sf):
    """Changes replace values, nulls in them don't."""
    u = users(spark, sf)
    changes = u.select("id", F.lit(None).cast("string").alias("name"), F.when(F.col("id") % 2 == 0, F.upper("segment")).alias("segment"))
    return R.patched(u, changes, "id").select("id", "name", "segment")


@query("select s_suppkey as id, s_name as name, s_suppkey % 3 <> 0 as has_api_key from supplier")
def secret_mask(spark, sf):
    s = table(spark, sf, "supplier")
    cipher = F.when(F.col("s_suppkey") % 3 != 0, F.md5("s_name")).when(F.col("s_suppkey") % 6 == 0, F.lit(""))
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), S.masked(cipher).alias("has_api_key"))


@query("select vec_id, label, case when label in (1, 2) then 'new' else 'old' end as origin from embeddings union all select vec_id + 1000000, label, 'new' from embeddings where label in (1, 2)")
def vector_upsert(spark, sf):
    """Vectors by id: new ones replace those of the same id and join the others."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    new = e.filter(F.col("label").isin(1, 2))
    new = new.unionByName(new.withColumn("vec_id", F.col("vec_id") + 1000000))
    return R.upserted(e.withColumn("origin", F.lit("old")), new.withColumn("origin", F.lit("new")), "vec_id")


@query("select vec_id, label, case when label in (1, 2) then 'new' else 'old' end as origin from embeddings union all select vec_id + 1000000, label, 'new' from embeddings where label in (1, 2)")
def vector_upsert_stored(spark, sf):
    """The same through a stored table, whose new rows become visible at once."""
    store = Store(spark, shared_path(spark, "store"), {"vectors": ("vec_id", "label")}, 8)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit("old").alias("origin"))
    store.upsert({"vectors": e})
    new = e.filter(F.col("label").isin(1, 2)).withColumn("origin", F.lit("new"))
    store.upsert({"vectors": new.unionByName(new.withColumn("vec_id", F.col("vec_id") + 1000000))})
    return store.read("vectors")


@query("select doc_id, source from documents union all select doc_id + 10000000, 'again' from documents where lang = 'fr'")
def chunk_insert_once(spark, sf):
    """Only rows whose id isn't there yet are appended."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    fr = d.filter("lang = 'fr'").select("doc_id", F.lit("again").alias("source"))
    return R.appended_once(d.select("doc_id", "source"), fr.unionByName(fr.withColumn("doc_id", F.col("doc_id") + 10000000)), "doc_id")


@query("select p_partkey as id, coalesce(case when p_size > 10 then p_partkey % 25 end, 9) as tenant_id from part")
def create_default_tenant(spark, sf):
    return R.created(models(spark, sf), 9).select("id", "tenant_id")


@query("select source as kb, max(case when source = 'src1' then 1 else 0 end)::bigint as deleted, count(*) as documents_left from documents group by source")
def soft_delete_knowledge_base(spark, sf):
    """A deleted base keeps its documents."""
    d = table(spark, sf, "documents").select(F.col("source").alias("kb"), F.lit(None).cast("timestamp").alias("deleted_at"))
    gone = R.soft_deleted(d, F.col("kb") == "src1", F.expr("timestamp '2024-02-01'"))
    return gone.groupBy("kb").agg(F.max(F.col("deleted_at").isNotNull().cast("long")).alias("deleted"), F.count("*").alias("documents_left"))


@query("select vec_id from embeddings where vec_id not in (select doc_id from documents where source in ('src2', 'src5'))")
def delete_document_vectors(spark, sf):
    """Vectors of deleted documents go."""
    gone = table(spark, sf, "documents").filter(F.col("source").isin("src2", "src5")).select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")


@query("select label, count(*) as n from embeddings where label <> 3 group by label")
def delete_tenant_vectors(spark, sf):
    return table(spark, sf, "embeddings").filter("label <> 3").groupBy("label").agg(F.count("*").alias("n"))


@query(f"with m as ({_MODELS}) select id, case when tenant_id is null then 403 when tenant_id <> 3 then 404 else 200 end as code from m")
def delete_model(spark, sf):
    """What deleting a model answers tenant 3: public ones are forbidden, others' not found."""
    return models(spark, sf).select("id", F.when(F.col("tenant_id").isNull(), 403).when(F.col("tenant_id") != 3, 404).otherwise(200).alias("code"))


@query(f"with m as ({_MODELS}) select id, coalesce(tenant_id, -1) as tenant_id from m where tenant_id is null or tenant_id <> 3")
def models_left(spark, sf):
    """Models after tenant 3 has deleted all that it may: its own; the others stay, public ones too."""
    m = models(spark, sf)
    gone = m.join(delete_model(spark, sf).filter("code = 200"), "id", "left_semi").select("id")
    return m.join(gone, "id", "left_anti").select("id", F.coalesce("tenant_id", F.lit(-1).cast("long")).alias("tenant_id"))


@query("""with d as (select doc_id, source as kb, doc_id % 7 = 0 as gone from documents)
  select kb, count(*) filter (gone) as deleted, count(*) filter (not gone) as document_count, (select count(*) from embeddings e join d x on e.vec_id = x.doc_id where not x.gone and x.kb = d.kb) as vectors from d group by kb""")
def soft_delete_documents(spark, sf):
    """Deleting documents sets their flag, counts them off their base and drops their vectors."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb"), F.lit(None).cast("timestamp").alias("deleted_at"))
    flagged = R.soft_deleted(d, F.col("doc_id") % 7 == 0, F.expr("timestamp '2024-02-01'"))
    gone = flagged.filter("deleted_at is not null").select(F.col("doc_id").alias("vec_id"))
    left = table(spark, sf, "embeddings").select("vec_id").join(gone, "vec_id", "left_anti")
    vectors = left.join(d, left.vec_id == d.doc_id).groupBy("kb").agg(F.count("*").alias("vectors"))
    per = flagged.groupBy("kb").agg(F.count("deleted_at").alias("deleted"), F.count_if(F.col("deleted_at").isNull()).alias("n"), F.count("*").alias("had"))
    per = per.select("kb", "deleted", S.clamped_subtract(F.col("had"), F.col("deleted")).cast("long").alias("document_count"))
    return per.join(vectors, "kb", "left").select("kb", "deleted", "document_count", F.coalesce("vectors", F.lit(0)).cast("long").alias("vectors"))


@query("""with b as (select distinct source as kb, case when length(source) = 4 then 'BAAI/bge-m3' else 'bge-large' end as model from documents),
  c as (select distinct 'kb_' || source as collection from documents where source like 'src1%')
  select 'kb_' || kb as collection, 1024 as size, c.collection is null as created from b left join c on c.collection = 'kb_' || kb""")
def collections_created(spark, sf):
    """Each base gets its collection, of the size of its model's vectors; one that exists already stays."""
    d = table(spark, sf, "documents")
    bases = d.select(F.concat(F.lit("kb_"), "source").alias("collection"), F.when(F.length("source") == 4, "BAAI/bge-m3").otherwise("bge-large").alias("model")).distinct()
    wanted = bases.select("collection", S.vector_size(F.col("model")).alias("size"), F.lit(True).alias("created"))
    there = wanted.filter(F.col("collection").startswith("kb_src1")).withColumn("created", F.lit(False))
    return R.appended_once(there, wanted, "collection")


@query("""select n_nationkey::bigint as tenant_id, 'tenant' as kind, n_name as what from nation union all select n_nationkey, 'user', lower(n_name) || '@mail.org' from nation
  union all select n_nationkey, 'role', 'tenant_' || r || '_' || n_nationkey from nation, (values ('admin'), ('member')) v(r) union all select n_nationkey, 'user_role', lower(n_name) || '@mail.org' || '>tenant_admin_' || n_nationkey from nation""")
def registration_rows(spark, sf):
    """All rows that registering a tenant inserts: tenant, first user, two roles, and the user's role."""
    n = table(spark, sf, "nation")
    t, mail = F.col("n_nationkey"), F.concat(F.lower("n_name"), F.lit("@mail.org"))
    row = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("what"))
    rows = F.array(row("tenant", F.col("n_name")), row("user", mail), row("role", S.role_code("admin", t)), row("role", S.role_code("member", t)), row("user_role", F.concat(mail, F.lit(">"), S.role_code("admin", t))))
    return n.select(t.cast("long").alias("tenant_id"), F.explode(rows).alias("r")).select("tenant_id", "r.kind", "r.what")


@query(f"with m as ({_MODELS}) select s_suppkey as id, count(m.id) as n_models, count(m.id) = 0 as deletable from supplier left join m on s_suppkey = provider_id and kind like 'PROMO%' group by s_suppkey")
def provider_deletable(spark, sf):
    """A provider can go once no model is left."""
    n = models(spark, sf).filter("kind like 'PROMO%'").groupBy("provider_id").agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.join(n, F.col("id") == F.col("provider_id"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_models"), F.col("n").isNull().alias("deletable"))


@query(f"with m as ({_MODELS}) select m.id, s_name as provider, s_nationkey::bigint as provider_tenant from m join supplier on s_suppkey = provider_id")
def model_provider(spark, sf):
    s = table(spark, sf, "supplier")
    return models(spark, sf).join(s, F.col("provider_id") == F.col("s_suppkey")).select("id", F.col("s_name").alias("provider"), F.col("s_nationkey").cast("long").alias("provider_tenant"))


@query(f"with m as ({_MODELS}) select m.id, coalesce(s_name, 'Provider #' || provider_id) as shown from m left join supplier on s_suppkey = provider_id and s_acctbal > 0")
def provider_names(spark, sf):
    """Names of providers, with a stand-in for those that aren't listed."""
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")
    return models(spark, sf).join(s, F.col("provider_id") == F.col("s_suppkey"), "left").select("id", F.coalesce("s_name", F.concat(F.lit("Provider #"), F.col("provider_id").cast("string"))).alias("shown"))


@query(f"with m as ({_MODELS}) select c.c_custkey as agent_id, m.id as model_id, s_suppkey as provider_id from customer c join m on m.id = c.c_custkey join supplier on s_suppkey = m.provider_id")
def agent_model_provider(spark, sf):
    """Documented only: agent, its model, that model's provider."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("agent_id"))
    m = models(spark, sf).select(F.col("id").alias("model_id"), "provider_id")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"))
    return a.join(m, F.col("agent_id") == F.col("model_id")).join(s, "provider_id").select("agent_id", "model_id", "provider_id")


@query("select d.doc_id, k.kb, k.tenant from documents d join (select distinct source as kb, length(source) as tenant from documents) k on d.source = k.kb and length(d.source) = k.tenant")
def document_knowledge_base(spark, sf):
    """Document and base of one tenant, deleted or not."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb"), F.length("source").cast("long").alias("tenant"))
    return d.join(d.select("kb", "tenant").distinct(), ["kb", "tenant"]).select("doc_id", "kb", "tenant")


@query("select o_custkey as user_id, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') as last_login_at from orders group by o_custkey")
def last_login(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("t"))
    return o.select("user_id", S.iso(F.col("t")).alias("last_login_at"))


@query("select n_nationkey::bigint as tenant_id, n_name as name, 'tenant_admin_' || n_nationkey as admin_code, 'tenant_member_' || n_nationkey as member_code, coalesce(nullif(case when n_nationkey % 2 = 0 then n_name end, ''), split_part(lower(n_name) || '@mail.org', '@', 1)) as shown from nation")
def register_tenant(spark, sf):
    """A tenant's first rows: role codes, and a name from the nickname or else the address."""
    n = table(spark, sf, "nation")
    nick = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit(""))
    return n.select(F.col("n_nationkey").cast("long").alias("tenant_id"), F.col("n_name").alias("name"), S.role_code("admin", F.col("n_nationkey")).alias("admin_code"), S.role_code("member", F.col("n_nationkey")).alias("member_code"), S.tenant_name(nick, F.concat(F.lower("n_name"), F.lit("@mail.org"))).alias("shown"))


@query(f"with u as ({_USERS}) select c.c_custkey as id, not exists (select 1 from u where u.name = c.c_name and u.tenant_id < 12) as free from customer c")
def email_is_free(spark, sf):
    """An address is taken by any row, deleted or of another tenant."""
    taken = users(spark, sf).filter("tenant_id < 12").select(F.col("name").alias("c_name"), F.lit(True).alias("taken")).distinct()
    return table(spark, sf, "customer").join(taken, "c_name", "left").select(F.col("c_custkey").alias("id"), F.col("taken").isNull().alias("free"))


@query(f"with u as ({_USERS}) select tenant_id, count(*) as purged from u where tenant_id in (1, 2) and (deleted_at is null or deleted_at < timestamp '2024-05-01' - interval 90 day) group by tenant_id")
def tenant_purge(spark, sf):
    """Documented only: rows of a purged tenant that have gone, at once or after 90 days."""
    at = F.expr("timestamp '2024-05-01' - interval 90 days")
    return users(spark, sf).filter(F.col("tenant_id").isin(1, 2)).filter(F.col("deleted_at").isNull() | (F.col("deleted_at") < at)).groupBy("tenant_id").agg(F.count("*").alias("purged"))


@query("""with u as (select c_custkey as id, c_nationkey in (1, 2) as gone, case when c_acctbal < 0 then timestamp '2024-01-01' end as deleted_at from customer),
  o as (select o_orderkey as id, gone from orders left join u on u.id = o_custkey), s as (select s_nationkey in (1, 2) as gone from supplier),
  m as (select s_nationkey in (1, 2) as gone from part join supplier on s_suppkey = p_partkey % (select count(*) from supplier))
  select 'tenants' as name, count(*) as before, count(*) filter (n_nationkey not in (1, 2)) as live, count(*) as after from nation
  union all select 'users', count(*), count(*) filter (deleted_at is null and not gone), count(*) filter (deleted_at is null) from u
  union all select 'prompts', count(*), count(*) filter (not coalesce(gone, false)), count(*) from o
  union all select 'providers', count(*), count(*) filter (not gone), count(*) from s
  union all select 'models', count(*), count(*) filter (not gone), count(*) from m
  union all select 'token_usages', count(*), count(*), count(*) from lineitem
  union all select 'audit_logs', count(*), count(*), count(*) from events""")
def tenant_purge_cascade(spark, sf):
    """Documented only: two tenants purged with all that belongs to them; usage and audit stay, and what was deleted over 90 days before is gone."""
    none = F.lit(None).cast("timestamp").alias("deleted_at")
    suppliers = table(spark, sf, "supplier").count()
    tables = {
        "tenants": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), none), "users": users(spark, sf).select("id", "tenant_id", "deleted_at"),
        "prompts": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("created_by"), none), "providers": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tenant_id"), none),
        "models": table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % suppliers).alias("provider_id"), none),
        "token_usages": table(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("prompt_id")), "audit_logs": table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id"),
    }
    links = [("users", "tenant_id", "tenants"), ("providers", "tenant_id", "tenants"), ("prompts", "created_by", "users"), ("models", "provider_id", "providers"), ("token_usages", "prompt_id", "prompts"), ("audit_logs", "user_id", "users")]
    purge = Purge(tables, dict.fromkeys(tables, "id"), links, {"token_usages", "audit_logs"})
    return purge.counts(purge.run({"tenants": F.col("id").isin(1, 2)}, F.expr("timestamp '2024-05-01'")))


@query("select event_type as name, user_id, count(*) as n from events group by all having count(*) > 1")
def config_duplicates(spark, sf):
    """Documented only: (name, owner) pairs that aren't unique."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("name"), "user_id").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"with m as ({_MODELS}) select id from m where tenant_id is null and status")
def public_plugins(spark, sf):
    """Documented only: rows without a tenant that are marked as public."""
    return models(spark, sf).filter("tenant_id is null and status").select("id")


@query("select n_nationkey::bigint as tenant_id, n_name as name, r_name as plan from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
def tenants_by_plan(spark, sf):
    """Documented only: tenants of a status or plan."""
    r = table(spark, sf, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("tenant_id"), F.col("n_name").alias("name"), F.col("r_name").alias("plan"))


@query(f"with u as ({_USERS}) select tenant_id, segment as role, count(*) as members, min(id) as first_id from u where deleted_at is null group by all")
def tenant_members(spark, sf):
    """Documented only: members of each tenant by role."""
    return users(spark, sf).filter("deleted_at is null").groupBy("tenant_id", F.col("segment").alias("role")).agg(F.count("*").alias("members"), F.min("id").alias("first_id"))


@query("select o_custkey as owner, o_orderkey as latest from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def latest_per_owner(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("latest"))


@query("select doc_id, case when lang = 'de' then 'v2' else 'v1' end as version from documents union all select doc_id, 'v2' from documents where lang = 'de'")
def reprocess_documents(spark, sf):
    """Documented only: the rows of reprocessed documents (two each) take the place of what these had."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    new = d.filter("lang = 'de'").select("doc_id", F.lit("v2").alias("version"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).drop("i")
    return R.replaced(d.select("doc_id", F.lit("v1").alias("version")), new, "doc_id")


@query("select p_brand as agent, count(*) filter (p_size > 25) as enabled, count(*) as tools from part group by p_brand")
def enabled_tools(spark, sf):
    """Documented only: enabled tools of each agent (a brand; its parts are tools)."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("agent")).agg(F.count_if(F.col("p_size") > 25).alias("enabled"), F.count("*").alias("tools"))


@query("select o_orderkey as node, case when o_orderstatus = 'F' then 'done' when o_totalprice > 100000 then 'review' else 'next' end as branch from orders")
def workflow_conditions(spark, sf):
    """Documented only: the branch that a condition node takes."""
    branch = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_totalprice") > 100000, "review").otherwise("next")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), branch.alias("branch"))
