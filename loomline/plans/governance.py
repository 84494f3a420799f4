"""Permissions, gates, quotas, rate limits, audit. user = customer, tenant = nation, hit and audit record = event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import limits
from ..sources.tables import table
from .catalogue import query
from .relational import _MODELS, _USERS, models, users

#: Fixed values of the stand-in: what each role (market segment) may do.
GRANTS = (("BUILDING", "prompt", "read"), ("BUILDING", "prompt", "write"), ("MACHINERY", "prompt", "read"), ("HOUSEHOLD", "model", "read"), ("AUTOMOBILE", "model", "write"), ("AUTOMOBILE", "prompt", "read"))
_GRANTS = "(values " + ", ".join(f"('{r}', '{a}', '{b}')" for r, a, b in GRANTS) + ") g(role, resource, action)"
WRITES = ("purchase", "signup", "error")
SKIPPED = ("/auth/login", "/error")


def grants(spark):
    return spark.createDataFrame(list(GRANTS), "role string, resource string, action string")


@query(f"select c_custkey as id from customer where c_mktsegment like '%FURN%' or exists (select 1 from {_GRANTS} where role = c_mktsegment and resource = 'prompt' and action = 'write')")
def rbac_allowed(spark, sf):
    """Users whose roles grant an action, and admins (a role whose code holds a certain word), whom nothing is asked of."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"))
    granted = grants(spark).filter("resource = 'prompt' and action = 'write'").select("role").distinct()
    admin = F.col("role").contains("FURN")
    return c.filter(admin).select("id").unionByName(c.filter(~admin).join(granted, "role", "left_semi").select("id"))


@query(f"select c.c_custkey as id, coalesce(string_agg(g.resource || ':' || g.action, ',' order by g.resource, g.action), '') as permissions, count(g.role) as n from customer c left join {_GRANTS} on g.role = c.c_mktsegment group by c.c_custkey")
def user_permissions(spark, sf):
    """Each user's permissions through roles, none if there are none."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"))
    per = grants(spark).groupBy("role").agg(F.array_sort(F.collect_list(F.struct("resource", "action"))).alias("permissions"))
    nested = c.join(per, "role", "left").select("id", F.coalesce("permissions", F.array().cast("array<struct<resource:string,action:string>>")).alias("permissions"))
    return nested.select("id", F.array_join(F.transform("permissions", lambda p: F.concat_ws(":", p["resource"], p["action"])), ",").alias("permissions"), F.size("permissions").cast("long").alias("n"))


_ASKED = "case c_custkey % 4 when 0 then [] when 1 then ['prompt:write'] when 2 then ['prompt:read', 'model:write'] else ['model:read', 'prompt:read'] end"


@query(f"""with h as (select role, list(resource || ':' || action) as held from {_GRANTS} group by role),
  u as (select c_custkey as id, coalesce(held, []) as held, {_ASKED} as asked from customer left join h on role = c_mktsegment)
  select id, list_has_any(held, asked) as any_of, list_has_all(held, asked) as all_of, list_contains(held, 'prompt:read') as one, len(asked)::int as n from u""")
def permission_checks(spark, sf):
    """What each user holds through its role against what is asked of it: one, any of, all of. All of nothing is held, any of nothing isn't."""
    none = F.array().cast("array<string>")
    held = grants(spark).groupBy("role").agg(F.collect_list(F.concat_ws(":", "resource", "action")).alias("held"))
    k = F.col("id") % 4
    asked = F.when(k == 0, none).when(k == 1, F.array(F.lit("prompt:write"))).when(k == 2, F.array(F.lit("prompt:read"), F.lit("model:write"))).otherwise(F.array(F.lit("model:read"), F.lit("prompt:read")))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role")).join(held, "role", "left")
    c = c.select("id", F.coalesce("held", none).alias("held"), asked.alias("asked"))
    return c.select("id", S.has_any(F.col("held"), F.col("asked")).alias("any_of"), S.has_all(F.col("held"), F.col("asked")).alias("all_of"), F.array_contains("held", "prompt:read").alias("one"), F.size("asked").alias("n"))


@query(f"select r.code, g.resource, g.action from (select 'tenant_' || (case when n_nationkey % 2 = 0 then 'admin_' else 'memberX' end) || n_nationkey as code from nation) r, {_GRANTS} where g.resource = 'prompt' and (r.code like 'tenant_admin_%' or r.code like 'tenant_member_%') and not (r.code like '%4' and g.action = 'read')")
def role_permission_seed(spark, sf):
    """Roles of two patterns (in which _ is any character) by permissions, those that exist already left out."""
    n = table(spark, sf, "nation")
    roles = n.select(F.concat(F.lit("tenant_"), F.when(F.col("n_nationkey") % 2 == 0, "admin_").otherwise("memberX"), F.col("n_nationkey").cast("string")).alias("code")).filter(F.col("code").like("tenant_admin_%") | F.col("code").like("tenant_member_%"))
    perms = F.array(*[F.struct(F.lit(a).alias("resource"), F.lit(b).alias("action")) for r, a, b in GRANTS if a == "prompt"])
    pairs = roles.select("code", F.explode(perms).alias("p")).select("code", "p.*")
    there = pairs.filter(F.col("code").endswith("4") & (F.col("action") == "read"))  # seeded before
    return pairs.join(there, ["code", "resource", "action"], "left_anti")


@query(f"with u as ({_USERS}) select u.id, case when n_nationkey is null or n_nationkey % 11 = 0 then 'no tenant' when n_nationkey % 7 = 3 then 'tenant disabled' when u.deleted_at is not null then 'no user' end is null as passes, coalesce(case when n_nationkey is null or n_nationkey % 11 = 0 then 'no tenant' when n_nationkey % 7 = 3 then 'tenant disabled' when u.deleted_at is not null then 'no user' end, '') as reason from u left join nation on n_nationkey = tenant_id")
def request_gate(spark, sf):
    """Why a request of each user is refused: its tenant is missing, deleted or disabled, or the user is."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant_id"), (F.col("n_nationkey") % 11 == 0).alias("gone"), (F.col("n_nationkey") % 7 != 3).alias("on"))
    u = users(spark, sf).join(n, "tenant_id", "left")
    reason = F.when(F.coalesce("gone", F.lit(True)), "no tenant").when(~F.col("on"), "tenant disabled").when(F.col("deleted_at").isNotNull(), "no user")
    return u.select("id", reason.isNull().alias("passes"), F.coalesce(reason, F.lit("")).alias("reason"))


@query(f"""with u as ({_USERS}), r as (select event_id, if(event_type = 'view', 'refresh', if(event_type = 'error', null, 'access')) as kind, if(event_id % 50 = 0, 0, user_id * 11) as sub from events)
  select event_id, case when kind is distinct from 'access' then 'invalid token type' when sub = 0 then 'invalid token' when u.id is null or deleted_at is not null then 'user not found' when sub % 7 = 0 then 'user is disabled' else '' end as reason
  from r left join u on u.id = sub""")
def user_gate(spark, sf):
    """Why a request's token is refused: it isn't an access token, names nobody, or its user is deleted or disabled."""
    kind = F.when(F.col("event_type") == "view", "refresh").when(F.col("event_type") != "error", "access")
    r = table(spark, sf, "events").select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.col("user_id") * 11).cast("long").alias("sub"))
    u = users(spark, sf).select(F.col("id").alias("sub"), (F.col("id") % 7 != 0).alias("status"), "deleted_at", F.lit(True).alias("there"))
    return limits.user_gate(r, u).select("event_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(f"with u as ({_USERS}), n as (select tenant_id, count(*) as used from u where deleted_at is null group by tenant_id) select n_nationkey::bigint as tenant_id, coalesce(used, 0) as used, (40 + n_nationkey % 30)::bigint as max_users, coalesce(used, 0) >= 40 + n_nationkey % 30 as exceeded, round(coalesce(used, 0) / (40 + n_nationkey % 30), 4) as share from nation left join n on n_nationkey = tenant_id")
def quota_users(spark, sf):
    """Users of each tenant against its limit; one more is refused at the limit."""
    limits_ = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant_id"), (40 + F.col("n_nationkey") % 30).cast("long").alias("max_users"))
    return limits.quota(users(spark, sf).filter("deleted_at is null"), limits_, "max_users")


@query(f"with m as ({_MODELS}), n as (select tenant_id, count(*) as used from m where tenant_id is not null group by tenant_id) select n_nationkey::bigint as tenant_id, coalesce(used, 0) as used, (50 + n_nationkey)::bigint as max_models, coalesce(used, 0) >= 50 + n_nationkey as exceeded, round(coalesce(used, 0) / (50 + n_nationkey), 4) as share from nation left join n on n_nationkey = tenant_id")
def quota_models(spark, sf):
    """The same for models; public ones belong to no tenant."""
    limits_ = table(spark, sf, "nation").select(F.col("n_nationkey").alias("tenant_id"), (50 + F.col("n_nationkey")).cast("long").alias("max_models"))
    return limits.quota(models(spark, sf), limits_, "max_models")


_HITS = "select distinct user_id, event_type, epoch_us(ts) as us from events"


@query(f"with h as ({_HITS}), n as (select *, count(*) over (partition by user_id, event_type order by us range between 86399999999 preceding and current row) as hits from h) select user_id, event_type, us, hits, hits > case when event_type = 'signup' then 1 else 3 end as denied from n")
def rate_limited(spark, sf):
    """Hits in the sliding window that ends with each, and whether it is over its path's limit; equal times count once."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return limits.sliding_window(e, ["user_id", "event_type"], "us", 86_400, F.when(F.col("event_type") == "signup", 1).otherwise(3))


@query("select event_id, event_type, user_id, floor(value)::bigint as duration_ms from events where event_type in ('purchase', 'signup', 'error') and not ('/' || event_type like '/error%')")
def audit_writes(spark, sf):
    """Audit records of writing requests whose path isn't skipped."""
    e = table(spark, sf, "events").withColumn("path", F.concat(F.lit("/api/"), F.col("event_type")))
    return e.filter(F.col("event_type").isin(*WRITES) & ~S.under_any(F.col("path"), list(SKIPPED))).select("event_id", "event_type", "user_id", F.floor("value").cast("long").alias("duration_ms"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, event_type as action from events where event_type in ('error', 'purchase') and user_id between 10 and 60 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' order by ts desc, event_id desc limit 50")
def audit_search(spark, sf):
    """Documented only: audit by action, user and dates, newest first, a page."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("error", "purchase") & F.col("user_id").between(10, 60))
    e = e.filter("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", S.iso(F.col("ts")).alias("at"), F.col("event_type").alias("action"))


@query("select event_id, case when event_type = 'view' then 'open' when event_type = 'click' then 'skipped' else 'checked' end as gate from events")
def path_whitelist(spark, sf):
    """Paths below an open prefix aren't checked; one leading /api doesn't count."""
    path = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/x"))
    return table(spark, sf, "events").select("event_id", F.when(S.under_any(path, ["/view"]), "open").when(S.under_any(path, ["/cli", "/health"]), "skipped").otherwise("checked").alias("gate"))


@query("select event_id, greatest((100 - event_id % 150)::bigint, 1) as ttl from events e where not exists (select 1 from events b where b.event_type = 'error' and b.user_id = e.user_id and b.value > 50 and b.ts <= e.ts and e.ts < b.ts + interval 7 day) ")
def token_blacklist(spark, sf):
    """Requests whose token isn't on the list of revoked, not yet expired ones; what a revoked one would have left."""
    e = table(spark, sf, "events")
    black = e.filter("event_type = 'error' and value > 50").select(F.col("user_id").alias("token"), F.col("ts").alias("revoked"), S.expires_at(F.col("ts"), F.lit("refresh")).alias("expires"))
    listed = (F.col("user_id") == F.col("token")) & (F.col("revoked") <= F.col("ts")) & (F.col("ts") < F.col("expires"))
    return e.join(black, listed, "left_anti").select("event_id", S.ttl_seconds(F.lit(100), F.col("event_id") % 150).alias("ttl"))


@query("select event_id, strftime(ts + case when event_type = 'click' then interval 5 minute else interval 7 day end, '%Y-%m-%dT%H:%M:%S') as expires from events where event_type in ('click', 'view')")
def token_expiry(spark, sf):
    """When access and refresh tokens issued at an event end."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    kind = F.when(F.col("event_type") == "click", "access").otherwise("refresh")
    return e.select("event_id", S.iso(S.expires_at(F.col("ts"), kind)).alias("expires"))


@query(f"""with ur as (select c_custkey as user_id, c_mktsegment as role from customer union select c_custkey, 'BUILDING' from customer where c_nationkey % 5 = 0),
  p as (select row_number() over (order by resource, action) as id, resource, action from (select distinct resource, action from {_GRANTS})),
  rp as (select g.role, p.id as permission_id from {_GRANTS} join p using (resource, action))
  select user_id, string_agg(resource || ':' || action, ',' order by resource, action) as permissions, count(*) as n from (select distinct user_id, resource, action from ur join rp using (role) join p on p.id = permission_id) group by user_id""")
def user_permissions_bridged(spark, sf):
    """Permissions of users with several roles, through both bridge tables; a permission that two roles grant counts once."""
    c = table(spark, sf, "customer")
    user_roles = c.select(F.col("c_custkey").alias("user_id"), F.explode(F.array_distinct(F.array_compact(F.array("c_mktsegment", F.when(F.col("c_nationkey") % 5 == 0, "BUILDING"))))).alias("role"))
    g = grants(spark)
    permissions = g.select("resource", "action").distinct().withColumn("permission_id", F.xxhash64("resource", "action"))
    role_permissions = g.join(permissions, ["resource", "action"]).select("role", "permission_id")
    held = user_roles.join(role_permissions, "role").join(permissions, "permission_id").select("user_id", "resource", "action").distinct()
    per = held.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("resource", "action"))).alias("p"))
    return per.select("user_id", F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["resource"], p["action"])), ",").alias("permissions"), F.size("p").cast("long").alias("n"))


@query("select event_id, case event_id % 4 when 0 then '10.0.0.' || user_id when 1 then '172.16.0.1' when 2 then '192.168.0.9' else 'unknown' end as ip from events")
def client_ip(spark, sf):
    k = F.col("event_id") % 4
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 1.1.1.1"))).when(k == 1, F.lit(""))
    return table(spark, sf, "events").select("event_id", S.client_ip(forwarded, F.when(k == 1, F.lit("172.16.0.1")), F.when(k == 2, F.lit("192.168.0.9"))).alias("ip"))


@query("select event_type, count(*) as hits, count(*) filter (value > 50) as slow from events group by event_type")
def audit_by_action(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("hits"), F.count_if(F.col("value") > 50).alias("slow"))


@query("select user_id, event_type, n, coalesce(n - lag(n) over (partition by user_id order by event_type), 0) as more from (select user_id, event_type, count(*) as n from events group by all)")
def activity_deltas(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("user_id").orderBy("event_type"))
    return n.select("user_id", "event_type", "n", F.coalesce(F.col("n") - before, F.lit(0)).cast("long").alias("more"))
