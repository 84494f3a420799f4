"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> None:
    """A dump with a header, a file per partition; timestamps as ISO text."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz")}
    df.withColumns(times).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    """Rows added to a Parquet table, in folders by some columns so that readers prune them."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def prompt_test_log(runs: DataFrame) -> DataFrame:
    """Rows of prompt test runs as they are logged: a failed one has no result, and its message is left empty."""
    return runs.withColumn("result_content", F.when(F.col("status") == "success", F.col("result_content"))).withColumn("error_msg", F.lit(None).cast("string"))


def last_logins(logins: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    return logins.groupBy(user).agg(F.max(at).alias("last_login_at"))


def blacklist(tokens: DataFrame, now: int) -> DataFrame:
    """token and expires_at (epoch seconds) of revoked tokens that were readable; an expired one stays for a second."""
    return tokens.filter(F.col("exp").isNotNull()).select("token", (F.lit(now) + F.greatest((F.col("exp") - now).cast("long"), F.lit(1).cast("long"))).alias("expires_at"))
