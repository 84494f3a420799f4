"""Usage, cost and dashboards, as the documents of the platform specify them. call = line item, tokens = quantity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import sketches, workflow
from ..operators.shared import saved
from ..sources.tables import table
from .catalogue import query

_CALLS = """select l_orderkey, l_linenumber, l_partkey as model_id, o_custkey as user_id, c_nationkey::bigint as tenant_id, strftime(l_shipdate, '%Y-%m-%d') as day,
  l_quantity::bigint as prompt_tokens, (l_linenumber * 3)::bigint as completion_tokens, l_returnflag as status, cast(round(l_extendedprice * 100) as bigint) as latency
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""
_SUMS = "count(*) as requests, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(prompt_tokens + completion_tokens)::bigint as total_tokens, round(sum(prompt_tokens * 2 + completion_tokens * 6) / 1000.0, 4)::double as cost"


def calls(spark, sf, which=None):
    li = table(spark, sf, "lineitem")
    li = (li if which is None else li.filter(which)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_extendedprice", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("model_id"), F.col("o_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.col("l_quantity").cast("long").alias("prompt_tokens"), (F.col("l_linenumber") * 3).cast("long").alias("completion_tokens"), F.col("l_returnflag").alias("status"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("latency"),
    )


def sums():
    """Requests, tokens and cost; prices are 2 and 6 per 1000 tokens."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = F.sum(F.col("prompt_tokens") * 2 + F.col("completion_tokens") * 6) / F.lit(1000.0)
    return [F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.round(cost, 4).alias("cost")]


@query(f"with c as ({_CALLS}) select day, {_SUMS} from c group by day")
def token_usage_daily(spark, sf):
    return calls(spark, sf).groupBy("day").agg(*sums())


@query(f"with c as ({_CALLS}) select model_id, {_SUMS} from c group by model_id")
def token_usage_by_model(spark, sf):
    return calls(spark, sf).groupBy("model_id").agg(*sums())


@query(f"with c as ({_CALLS}) select user_id, {_SUMS} from c group by user_id")
def token_usage_by_user(spark, sf):
    return calls(spark, sf).groupBy("user_id").agg(*sums())


@query(f"with c as ({_CALLS}) select model_id, count(*) as requests, round(avg(latency), 4) as mean_latency, max(latency) as worst, count(*) filter (status = 'R') as returned, count(*) filter (status = 'A') as accepted from c group by model_id")
def model_call_stats(spark, sf):
    """Requests, latency and outcomes by model."""
    return calls(spark, sf).groupBy("model_id").agg(F.count("*").alias("requests"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.max("latency").alias("worst"), F.count_if(F.col("status") == "R").alias("returned"), F.count_if(F.col("status") == "A").alias("accepted"))


@query(f"with c as ({_CALLS}) select model_id, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.95) as p95, quantile_disc(latency, 0.99) as p99 from c group by model_id")
def model_call_quantiles(spark, sf):
    """Exact quantiles of latency by model."""
    return sketches.exact_quantiles(calls(spark, sf), "model_id", "latency")


_RANGE = ("1996-03-01", "1999-08-31")


@query(f"with c as ({_CALLS}) select tenant_id, count(*) as requests, sum(prompt_tokens + completion_tokens)::bigint as tokens, true as users_near, true as p95_near from c where day between '{_RANGE[0]}' and '{_RANGE[1]}' group by tenant_id")
def usage_over_range(spark, sf):
    """Any range of days out of sketches by day: sums are exact, distinct users within 10 % and the 95th percentile within 2 % of ranks of the exact one."""
    c = calls(spark, sf)
    days = saved(sketches.by_day(c, "tenant_id"), "usage-days")
    got = sketches.over(days, *_RANGE, "tenant_id")
    own = c.filter(F.col("day").between(*_RANGE)).join(got.select("tenant_id", F.col("p95").alias("at")), "tenant_id")
    exact = own.groupBy("tenant_id").agg(F.count_distinct("user_id").alias("n_users"), F.avg((F.col("latency") <= F.col("at")).cast("double")).alias("upto"), F.avg((F.col("latency") < F.col("at")).cast("double")).alias("below"))
    near = (F.col("upto") >= 0.93) & (F.col("below") <= 0.97)
    return got.join(exact, "tenant_id").select("tenant_id", "requests", "tokens", (F.abs(F.col("users") - F.col("n_users")) <= 0.1 * F.col("n_users")).alias("users_near"), near.alias("p95_near"))


@query(f"with c as ({_CALLS}), d as (select max(day) as day from c) select day, count(*) as requests, count(distinct user_id) as active_users, sum(prompt_tokens + completion_tokens)::bigint as tokens, count(distinct model_id) as models from c where day = (select day from d) group by day")
def dashboard_today(spark, sf):
    """The last day: requests, users, tokens, models."""
    # The last day is known from the calls alone; of them only its rows go on to the joins.
    last = table(spark, sf, "lineitem").agg(F.date_trunc("day", F.max("l_shipdate")).alias("t")).first()["t"]
    c = calls(spark, sf, F.lit(True) if last is None else F.col("l_shipdate") >= F.lit(last).cast("timestamp_ntz"))
    return c.groupBy("day").agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("active_users"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.count_distinct("model_id").alias("models"))


@query(f"with c as ({_CALLS}) select n_nationkey::bigint as tenant_id, count(c.tenant_id) as requests, count(distinct user_id) as users, coalesce(sum(prompt_tokens + completion_tokens), 0)::bigint as tokens from nation left join c on tenant_id = n_nationkey group by n_nationkey")
def tenant_stats(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tenant_id"))
    own = calls(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    return n.join(own, "tenant_id", "left").select("tenant_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("requests", "users", "tokens")])


@query(f"with c as ({_CALLS}), d as (select day, count(*) as requests from c group by day) select day, requests, coalesce(requests - lag(requests) over (order by day), 0)::bigint as more from d")
def daily_trend(spark, sf):
    """Requests a day and how many more than the day before; the window runs over days, which are few."""
    d = calls(spark, sf).groupBy("day").agg(F.count("*").alias("requests"))
    return d.select("day", "requests", F.coalesce(F.col("requests") - F.lag("requests").over(Window.orderBy("day")), F.lit(0)).cast("long").alias("more"))


@query("select (select count(*) from customer) as users, (select count(*) from part) as models, (select count(*) from documents) as documents, (select count(*) from orders) as prompts")
def dashboard_tiles(spark, sf):
    """Four counts."""
    parts = [table(spark, sf, t).agg(F.count("*").alias(n)) for t, n in (("customer", "users"), ("part", "models"), ("documents", "documents"), ("orders", "prompts"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 4")
def chat_memory_last_k(spark, sf):
    """The last 2 exchanges (4 messages) of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 4").select("conv_id", "turn", "role")


@query("select conv_id, turn, case role when 'system' then 'system' when 'assistant' then 'ai' else 'human' end as kind, coalesce(length(text), 0)::bigint as n_chars from conversations")
def chat_messages(spark, sf):
    """Roles as message types; content that is missing is blank."""
    return table(spark, sf, "conversations").select("conv_id", "turn", S.message_type(F.col("role")).alias("kind"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


@query("with recursive t as (select conv_id, turn, turn as root, 0 as depth from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 2) union all select c.conv_id, c.turn, t.root, t.depth + 1 from t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 2) select conv_id, turn, root, depth::bigint as depth from t")
def message_branches(spark, sf):
    """Documented only: each message's branch (first ancestor by parent) and depth; here the parent lies two turns back."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    nodes = c.select(F.struct("conv_id", "turn").alias("id"), F.struct("conv_id", (F.col("turn") - 2).alias("turn")).alias("parent"))
    out = workflow.ancestors(nodes)
    return out.select("id.conv_id", "id.turn", F.col("root.turn").alias("root"), "depth")


@query("""with recursive n as (select p_partkey as id from part),
  e as (select p_partkey as src, p_partkey * 2 + k as dst from part, (values (1), (2)) v(k) where p_partkey * 2 + k in (select id from n) union select p_partkey, p_partkey - 7 from part where p_size = 50 and p_partkey between 7 and 400),
  lv(id, level) as (select id, 0 from n where id not in (select dst from e) union select e.dst, lv.level + 1 from lv join e on e.src = lv.id where lv.level < 60)
  select id, max(level)::bigint as level from lv group by id having max(level) < 60""")
def workflow_levels(spark, sf):
    """Documented only: topological levels of a graph of nodes; those on or behind a cycle have none."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    tree = p.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("dst")).join(p.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")
    back = p.filter("p_size = 50 and id between 7 and 400").select(F.col("id").alias("src"), (F.col("id") - 7).alias("dst"))
    return workflow.levels(p.select("id"), tree.unionByName(back))


_PRICED = f"""with c as ({_CALLS}), m as (select p_partkey as model_id, cast(p_size / 1000.0 as decimal(10, 6)) as pin, cast(p_size / 250.0 as decimal(10, 6)) as pout from part),
  p as (select c.*, prompt_tokens * pin + completion_tokens * pout as amount from c join m using (model_id))"""


def priced(spark, sf, which=None):
    """calls with `amount`: tokens by the prices of their model (per 1000 tokens, exact decimals), still to be divided by 1000."""
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), *[(F.col("p_size") / F.lit(n)).cast("decimal(10,6)").alias(c) for n, c in ((1000.0, "pin"), (250.0, "pout"))])
    return calls(spark, sf, which).join(m, "model_id").withColumn("amount", F.col("prompt_tokens") * F.col("pin") + F.col("completion_tokens") * F.col("pout"))


@query(_PRICED + " select tenant_id, count(*) as requests, round(sum(amount)::double / 1000, 6) as cost from p group by tenant_id")
def token_cost(spark, sf):
    """Cost of each tenant by its models' prices."""
    return priced(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("requests"), F.round(F.sum("amount").cast("double") / 1000, 6).alias("cost"))


@query(_PRICED + " select model_id, count(*) as requests, count(distinct user_id) as users, round(sum(amount)::double / 1000, 6) as cost from p where day = (select max(day) from c) group by model_id")
def dashboard_models_today(spark, sf):
    """The last day by model, with cost."""
    last = table(spark, sf, "lineitem").agg(F.date_trunc("day", F.max("l_shipdate")).alias("t")).first()["t"]
    today = F.lit(True) if last is None else F.col("l_shipdate") >= F.lit(last).cast("timestamp_ntz")
    return priced(spark, sf, today).groupBy("model_id").agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"), F.round(F.sum("amount").cast("double") / 1000, 6).alias("cost"))


@query("select event_id, user_id, event_type as action from events order by ts desc, event_id desc limit 10")
def recent_audit(spark, sf):
    """Documented only: the ten newest audit records."""
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id", F.col("event_type").alias("action"))


@query("select user_id, count(*) as hits from events where ts >= (select max(ts) from events) - interval 7 day group by user_id")
def active_agents(spark, sf):
    """Documented only: who was active in the last seven days."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t")).first()["t"]  # known first, so that the scan itself leaves out older rows
    recent = F.lit(False) if last is None else F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days")
    return e.filter(recent).groupBy("user_id").agg(F.count("*").alias("hits"))
