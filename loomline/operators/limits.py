"""Gates, quotas and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(rows: DataFrame, limits: DataFrame, limit: str, key: str = "tenant_id") -> DataFrame:
    """key, used, the limit, whether it is reached, and the share: for every row of limits; rows without a key count for none."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_k")).agg(F.count("*").alias("used"))
    used = F.coalesce("used", F.lit(0)).cast("long")
    out = limits.select(F.col(key).cast("long").alias(key), limit).join(n, F.col(key) == F.col("_k"), "left")
    return out.select(key, used.alias("used"), limit, (used >= F.col(limit)).alias("exceeded"), F.round(used / F.col(limit), 4).alias("share"))


def sliding_window(hits: DataFrame, keys: list[str], micros: str, seconds: int, limit: Column) -> DataFrame:
    """keys, time, hits in the window that ends there, and whether they are over the limit. A hit exactly `seconds` old is out, denied hits count, and equal times are one hit."""
    # Spans of eight windows, each with the last window of the span before: a busy key is as many tasks as it has spans.
    window, span = seconds * 1_000_000, 8 * seconds * 1_000_000
    at = F.floor(F.col(micros) / span)
    own = F.struct(at.alias("span"), F.lit(True).alias("own"))
    next_too = F.when(F.col(micros) > (at + 1) * span - window, F.struct((at + 1).alias("span"), F.lit(False).alias("own")))
    rows = hits.select(*keys, micros).distinct().select(*keys, micros, F.explode(F.array_compact(F.array(own, next_too))).alias("_in"))
    w = Window.partitionBy(*keys, "_in.span").orderBy(micros).rangeBetween(-window + 1, 0)
    out = rows.withColumn("hits", F.count("*").over(w)).filter("_in.own").drop("_in")
    return out.withColumn("denied", F.col("hits") > limit)


def user_gate(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (kind, sub, ...) with reason: why a token of a kind for a user (sub) is refused; null if it isn't. The first that holds is told.

    users: sub, status, deleted_at, there (true).
    """
    known = requests.join(users, "sub", "left")
    reason = F.when(~F.coalesce(F.col("kind") == "access", F.lit(False)), "invalid token type").when(F.coalesce(F.col("sub"), F.lit(0)) == 0, "invalid token")
    reason = reason.when(F.col("there").isNull() | F.col("deleted_at").isNotNull(), "user not found").when(~F.coalesce("status", F.lit(False)), "user is disabled")
    return known.withColumn("reason", reason).select(*requests.columns, "reason")
