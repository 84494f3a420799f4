"""Prompts: variables, rendering, versions. prompt = customer, its versions = orders by date, template = text built from a document's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import diff
from ..operators import prompts as P
from ..sources.tables import table
from .catalogue import query
from .relational import _MODELS, models

_TEMPLATE = "'Write in {{lang}} about {{topic}}: {{größe}} {{lang}} {{ no }} {{' || source || '}}'"
_T = f"(select doc_id, lang, source, n_chars, {_TEMPLATE} as content from documents)"


def templates(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.withColumn("content", F.concat(F.lit("Write in {{lang}} about {{topic}}: {{größe}} {{lang}} {{ no }} {{"), "source", F.lit("}}")))


def versions(spark, sf) -> DataFrame:
    """prompt_id, id, version_number, content, is_current, created: a customer's orders by date."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_orderpriority").alias("content"))
    return P.numbered(o, "prompt_id", "o_orderdate", "id")


_SUBSEQUENCES = "list_transform(range(16), lambda m: array_to_string(list_filter({x}, lambda l, i: (m >> (i - 1)) & 1 = 1), chr(10)))"
_V = "(select o_custkey as prompt_id, o_orderkey as id, o_orderpriority as content, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version_number from orders)"


@query(f"select doc_id, 'lang,topic,größe,' || source as names, 4::bigint as n from {_T}")
def prompt_variables(spark, sf):
    """Names of a template, each once, as they first appear; with white space inside it is none."""
    v = S.variables(F.col("content"))
    return templates(spark, sf).select("doc_id", F.array_join(v, ",").alias("names"), F.size(v).cast("long").alias("n"))


@query(f"""select doc_id, replace(replace(replace(replace(content, '{{{{topic}}}}', 'a {{{{lang}}}} thing'), '{{{{lang}}}}', lang), '{{{{größe}}}}', n_chars::varchar), '{{{{' || source || '}}}}', 'x') as rendered from {_T}""")
def prompt_render(spark, sf):
    """Variables replaced one after the other: a value may bring in a later name."""
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    entries = F.array(pair(F.lit("topic"), F.lit("a {{lang}} thing")), pair(F.lit("lang"), F.col("lang")), pair(F.lit("größe"), F.col("n_chars").cast("string")), pair(F.col("source"), F.lit("x")))
    return templates(spark, sf).select("doc_id", S.render(F.col("content"), entries).alias("rendered"))


@query(f"select doc_id, 'missing variables: topic, größe' || case when n_chars % 2 = 0 then ', ' || source else '' end as error from {_T}")
def prompt_missing_variables(spark, sf):
    pair = lambda k: F.struct(k.alias("k"), F.lit("v").alias("v"))
    entries = F.when(F.col("n_chars") % 2 == 0, F.array(pair(F.lit("lang")), pair(F.lit("lang")))).otherwise(F.array(pair(F.lit("lang")), pair(F.col("source"))))
    return templates(spark, sf).select("doc_id", S.render_error(F.col("content"), entries).alias("error"))


@query(f"select doc_id, 'lang=' || lang || ';topic=;größe=;' || source || '=' as filled from {_T}")
def prompt_blank_defaults(spark, sf):
    """Every variable gets a value, blank if none is given."""
    m = F.map_entries(S.with_blanks(F.col("content"), F.create_map(F.lit("lang"), F.col("lang"))))
    return templates(spark, sf).select("doc_id", F.array_join(F.transform(m, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("filled"))


@query(f"select prompt_id, id, version_number::bigint as version_number, content from {_V}")
def prompt_versions(spark, sf):
    return versions(spark, sf).select("prompt_id", "id", F.col("version_number").cast("long").alias("version_number"), "content")


@query(f"select c_custkey as prompt_id, coalesce(max(version_number), 0)::bigint + 1 as next_version from customer left join {_V} v on prompt_id = c_custkey group by c_custkey")
def prompt_next_version(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id"))
    return P.next_version(p, versions(spark, sf), "prompt_id")


@query(f"select c_custkey as prompt_id, coalesce(v.id, -1) as version_id, coalesce(v.content, '') as content from customer left join (select * from {_V} where version_number = 2) v on prompt_id = c_custkey")
def prompt_current_version(spark, sf):
    """Prompts with their current version (here the second), if they have one."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id"))
    current = versions(spark, sf).filter("version_number = 2").select("prompt_id", "id", "content")
    return p.join(current, "prompt_id", "left").select("prompt_id", F.coalesce("id", F.lit(-1)).alias("version_id"), F.coalesce("content", F.lit("")).alias("content"))


@query(f"select prompt_id, arg_max(id, (version_number = 2)::int * 1000000 + version_number) as id from {_V} group by prompt_id")
def prompt_current_or_newest(spark, sf):
    """The current version (the second, where there is one), else the newest."""
    v = versions(spark, sf).withColumn("is_current", F.col("version_number") == 2)
    return P.current_or_newest(v, "prompt_id").select("prompt_id", "id")


@query(f"select prompt_id, id, id = max(id) over (partition by prompt_id) as is_current from {_V}")
def prompt_activate(spark, sf):
    """After activation exactly one version of a prompt is current."""
    v = versions(spark, sf)
    target = v.groupBy("prompt_id").agg(F.max("id").alias("target"))
    return P.activated(v, target, "prompt_id").select("prompt_id", "id", "is_current")


@query(f"select c_custkey as prompt_id, coalesce(v.content, '') <> '1-URGENT' as saved, coalesce(v.version_number, 0)::bigint + (coalesce(v.content, '') <> '1-URGENT')::int as version from customer left join (select * from {_V} qualify row_number() over (partition by prompt_id order by version_number desc) = 1) v on prompt_id = c_custkey")
def prompt_save_if_changed(spark, sf):
    """A new version is saved only if its content differs from the newest."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id"), F.lit("1-URGENT").alias("content"))
    return P.saved_if_changed(p, versions(spark, sf), "prompt_id")


@query(f"""with v as (select prompt_id, version_number, list(content) over (partition by prompt_id order by version_number rows between 3 preceding and current row) as lines from {_V}),
  p as (select *, coalesce(lag(lines) over (partition by prompt_id order by version_number), []) as before from v),
  -- all subsequences of four lines at most, as text
  s as (select *, {_SUBSEQUENCES.format(x="before")} as old, {_SUBSEQUENCES.format(x="lines")} as new from p),
  k as (select *, list_max(list_transform(list_intersect(old, new), lambda t: case when t = '' then 0 else len(string_split(t, chr(10))) end))::bigint as kept from s)
  select prompt_id, version_number::bigint as version_number, kept, len(lines) - kept as added, len(before) - kept as removed, md5(array_to_string(lines, chr(10))) as rebuilt from k""")
def prompt_version_diff(spark, sf):
    """Documented only: lines that each version keeps, adds and removes by a longest common subsequence, and what its script rebuilds. A version's lines are the last four priorities."""
    w = Window.partitionBy("prompt_id").orderBy("version_number").rowsBetween(-3, 0)
    v = versions(spark, sf).withColumn("content", F.array_join(F.collect_list("content").over(w), "\n"))
    d = diff.version_scripts(v, "prompt_id")
    n = lambda op: F.size(F.filter("script", lambda s: s["op"] == op)).cast("long").alias({"keep": "kept", "add": "added", "drop": "removed"}[op])
    return d.select("prompt_id", F.col("version_number").cast("long").alias("version_number"), n("keep"), n("add"), n("drop"), F.md5(diff.rebuilt()).alias("rebuilt"))


@query("select source as tag, count(*) as n from documents where lang in ('fr', 'de') group by source")
def prompt_tags_any(spark, sf):
    """Documented only: prompts with any of some tags."""
    d = table(spark, sf, "documents").withColumn("tags", F.array("lang", "source"))
    return d.filter(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("de")))).groupBy(F.col("source").alias("tag")).agg(F.count("*").alias("n"))


@query("select conv_id, turn, 'You said ' || role || '.' as rendered, length('You said ' || role || '.')::bigint as prompt_tokens, case when role = 'system' then 'error' else 'success' end as status, case when role = 'system' then '' else reverse('You said ' || role || '.') end as result from conversations")
def prompt_test_run(spark, sf):
    """Render, call the model (here one that reverses, and refuses some), and log: an error leaves a row without a result."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    entries = F.array(F.struct(F.lit("who").alias("k"), F.col("role").alias("v")))
    rendered = c.withColumn("rendered", S.render(F.lit("You said {{who}}."), entries))

    def model(text: str) -> dict:
        if "system" in text:
            raise ValueError("refused")
        return {"content": text[::-1], "prompt_tokens": len(text), "completion_tokens": len(text)}

    log = P.invoked(rendered, "rendered", model)
    return log.select("conv_id", "turn", "rendered", F.length("rendered").cast("long").alias("prompt_tokens"), "status", F.coalesce("result_content", F.lit("")).alias("result"))


@query("select doc_id, source as stripped, len(string_split(text, '. '))::bigint as parts, round(n_chars / 1024.0, 2) as kb, case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else 'other' end as label from documents")
def text_helpers(spark, sf):
    """Strip, literal split, size in KB, label lookup."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("en", "English", "fr", "French", "de", "German")]), F.col("lang")), F.lit("other"))
    return table(spark, sf, "documents").select("doc_id", S.strip(F.concat(F.lit(" \t　"), "source", F.lit("\n"))).alias("stripped"), F.size(S.split_literal(F.col("text"), ". ")).cast("long").alias("parts"), F.round(F.col("n_chars") / 1024.0, 2).cast("double").alias("kb"), label.alias("label"))


@query("select event_id, round((event_id % 997) / 997 * 100, 1) as shown, strftime(ts, '%Y-%m-%dT%H:%M') as minute from events")
def detail_helpers(spark, sf):
    """A score in per cent with one digit, a time up to its minute."""
    return table(spark, sf, "events").select("event_id", S.percent(F.col("event_id") % 997 / 997).alias("shown"), S.minute(F.col("ts")).alias("minute"))


@query("select o_orderkey as id, case when status not in ('draft', 'published', 'archived') then 'unknown status: ' || status when length(name) > 255 then 'name is too long' when length(category) > 100 then 'category is too long' else '' end as error from (select *, case o_orderstatus when 'F' then 'draft' when 'O' then 'Published' when 'P' then null end as status, repeat('n', (o_orderkey % 300)::int) as name, repeat('c', (o_orderkey % 120)::int) as category from orders)")
def prompt_update_errors(spark, sf):
    """Why an update of a prompt is refused: its status, or what is too long."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "draft").when(F.col("o_orderstatus") == "O", "Published")
    long = lambda c, n: F.repeat(F.lit(c), (F.col("o_orderkey") % n).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce(S.prompt_error(status, long("n", 300), long("c", 120)), F.lit("")).alias("error"))


@query("select p_partkey as id, case when p_size % 5 = 0 then '-' else '$' || printf('%.2f', p_size::double) || '/1K' end as shown, least(pow(2, p_size % 4), 5)::int as wait from part")
def price_and_backoff(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), S.price(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("shown"), S.backoff_seconds(F.col("p_size") % 4).alias("wait"))


@query(f"""with v as (select *, version_number = 2 as is_current from {_V}), m as ({_MODELS}),
  r as (select c_custkey as request_id, c_custkey as prompt_id, c_nationkey::bigint as tenant_id, case when c_custkey % 3 = 0 then (select min(id) from v where v.prompt_id = c_custkey) when c_custkey % 3 = 1 then -5 end as version_id, c_custkey % 400 as model_id from customer),
  d as (select prompt_id, arg_max(id, is_current::int * 1000000 + version_number) as id from v group by prompt_id),
  w as (select r.*, coalesce(r.version_id, case when c.c_custkey % 3 = 2 or (c.c_custkey % 3 = 0 and r.version_id is null) then d.id end) as wanted from r join customer c on c.c_custkey = r.request_id left join d using (prompt_id))
  select request_id, coalesce(v.id, -1) as version_id, case when v.id is null then 'version not found' when m.id is null then 'model not found' else '' end as error
  from w left join v on v.prompt_id = w.prompt_id and v.id = w.wanted left join m on m.id = w.model_id and m.status and (m.tenant_id is null or m.tenant_id = w.tenant_id)""")
def prompt_runs_to_make(spark, sf):
    """Which version each test request runs (the one asked for, the current one, the newest), with a model that its tenant may use; errors as data."""
    v = versions(spark, sf).withColumn("is_current", F.col("version_number") == 2)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("prompt_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), (F.col("c_custkey") % 400).alias("model_id"))
    first = v.groupBy("prompt_id").agg(F.min("id").alias("first"))
    asked = c.join(first, "prompt_id", "left").withColumn("version_id", F.when(F.col("prompt_id") % 3 == 0, F.col("first")).when(F.col("prompt_id") % 3 == 1, F.lit(-5).cast("long"))).drop("first")
    out = P.runs_to_make(asked, v, models(spark, sf))
    return out.select("request_id", F.when(F.col("content").isNotNull(), F.col("version_id")).otherwise(-1).alias("version_id"), F.coalesce("error", F.lit("")).alias("error"))


@query("select s_suppkey as id, s_suppkey % 3 <> 0 as ok, case when s_suppkey % 3 = 0 then 'no key for ' || s_name else '' end as message from supplier")
def provider_connectivity(spark, sf):
    """A test call to each provider (here one that needs a key); what fails says why."""
    s = table(spark, sf, "supplier")

    def call(name: str) -> None:
        if name.endswith("!"):
            raise ConnectionError(f"no key for {name[:-1]}")

    named = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("name"))
    return P.connectivity(named, "name", call).select("id", "ok", "message")
