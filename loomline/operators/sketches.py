"""Usage by day as rows that can be added up over any range of days: sums, and sketches of what sums can't say.

A day's latencies are a KLL sketch and its users an HLL sketch, a few KB each
whatever the day held. A range is the merge of its days, so it costs as many small
rows as it has days, and never the calls again. `exact_quantiles` gives the same
from the calls themselves.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Size of a KLL sketch (its ranks are off by less than 1 %, nearly always) and log2 of an HLL sketch's cells (users off by 1.6 % on average).
KLL, HLL = 400, 12


def by_day(calls: DataFrame, *keys: str) -> DataFrame:
    """day, keys, requests, tokens, latency and users (sketches) of calls (day, keys, latency, user_id, prompt_tokens, completion_tokens). Null latencies and users are in no sketch."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return calls.groupBy("day", *keys).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"), F.kll_sketch_agg_bigint("latency", KLL).alias("latency"), F.hll_sketch_agg("user_id", HLL).alias("users"))


def merged(days: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys out of rows of by_day. With `day` among keys, days that came in parts become whole."""
    return days.groupBy(*keys).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.kll_merge_agg_bigint("latency", KLL).alias("latency"), F.hll_union_agg("users").alias("users"))


def over(days: DataFrame, first: str, last: str, *keys: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """keys, requests, tokens, users and p50, p95, ... (null without a latency) of the days first to last."""
    sums = merged(days.filter(F.col("day").between(first, last)), *keys)
    some = F.kll_sketch_get_n_bigint("latency") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_bigint("latency", F.lit(q))).alias(f"p{100 * q:g}".replace(".", "_")) for q in quantiles]
    return sums.select(*keys, "requests", "tokens", F.hll_sketch_estimate("users").alias("users"), *at)


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """key and p50, p95, ...: the least value that at least that share of the key's values don't exceed; nulls don't count.

    Equal values are counted before they are ordered, so a crowded key costs as many rows as it has different values.
    """
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    n = n.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    least = lambda q: F.min(F.when(F.col("upto") * 1_000_000 >= F.col("total") * ceil(q * 1_000_000), F.col("value")))
    return n.groupBy(key).agg(*[least(q).alias(f"p{100 * q:g}".replace(".", "_")) for q in quantiles])
