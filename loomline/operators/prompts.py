"""Prompt versions and test runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, prompt: str, *order: str) -> DataFrame:
    """rows with version_number from 1 within each prompt."""
    return rows.withColumn("version_number", F.row_number().over(Window.partitionBy(prompt).orderBy(*order)))


def next_version(prompts: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """The number of each prompt's next version; 1 without any."""
    top = versions.groupBy(key).agg(F.max("version_number").alias("top"))
    return prompts.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)).cast("long") + 1).alias("next_version"))


def current_or_newest(versions: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("is_current"), F.desc("version_number"))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def activated(versions: DataFrame, targets: DataFrame, key: str, id: str = "id") -> DataFrame:
    """versions with is_current true in the target of its prompt alone; prompts without a target stay as they are."""
    is_target = F.col(id) == F.col("target")
    was = F.col("is_current") if "is_current" in versions.columns else F.lit(False)
    out = versions.join(targets.select(key, "target"), key, "left")
    return out.withColumn("is_current", F.when(F.col("target").isNull(), was).otherwise(is_target)).drop("target")


def saved_if_changed(drafts: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """For drafts (key, content): whether one differs from the newest version, and which number is the newest then."""
    newest = versions.groupBy(key).agg(F.max_by(F.struct("version_number", "content"), "version_number").alias("v"))
    changed = ~F.col("content").eqNullSafe(F.col("v.content"))
    return drafts.join(newest, key, "left").select(key, changed.alias("saved"), (F.coalesce("v.version_number", F.lit(0)) + changed.cast("int")).cast("long").alias("version"))


_LOG = "result_content string, prompt_tokens int, completion_tokens int, latency_ms int, status string"


def invoked(df: DataFrame, text: str, model) -> DataFrame:
    """df with the log of model(text) -> {content, prompt_tokens, completion_tokens}: usage that is missing is 0, and an error is a row without a result."""

    def one(t: str | None) -> tuple:
        import time

        began = time.perf_counter()
        try:
            out = model(t or "")
            return out["content"], int(out.get("prompt_tokens") or 0), int(out.get("completion_tokens") or 0), int(1000 * (time.perf_counter() - began)), "success"
        except Exception:  # noqa: BLE001  whatever a model's client raises
            return None, 0, 0, int(1000 * (time.perf_counter() - began)), "error"

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["result_content", "prompt_tokens", "completion_tokens", "latency_ms", "status"])

    return df.withColumn("_log", F.pandas_udf(run, _LOG)(F.col(text))).select(*df.columns, "_log.*")


def runs_to_make(requests: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """requests (request_id, prompt_id, tenant_id, version_id or null, model_id) with version and content to run, and error if there is nothing to run.

    The version asked for must be the prompt's own; without one it is the current, else the newest. A model must be on, and the tenant's own or public.
    versions: prompt_id, id, version_number, is_current, content; models: id, tenant_id or null, status.
    """
    chosen = requests.filter(F.col("version_id").isNotNull()).join(versions.select("prompt_id", F.col("id").alias("version_id"), "content"), ["prompt_id", "version_id"], "left")
    newest = current_or_newest(versions, "prompt_id").select("prompt_id", F.col("id").alias("found"), F.col("content").alias("text"))
    default = requests.filter(F.col("version_id").isNull()).join(newest, "prompt_id", "left").select(*[c for c in requests.columns if c != "version_id"], F.col("found").alias("version_id"), F.col("text").alias("content"))
    both = chosen.select(*requests.columns, "content").unionByName(default.select(*requests.columns, "content"))
    usable = models.filter("status").select(F.col("id").alias("_model"), F.col("tenant_id").alias("_of"))
    may = (F.col("model_id") == F.col("_model")) & (F.col("_of").isNull() | (F.col("_of") == F.col("tenant_id")))
    error = F.when(F.col("content").isNull(), "version not found").when(F.col("_model").isNull(), "model not found")
    return both.join(usable, may, "left").select(*requests.columns, "content", error.alias("error"))


def connectivity(df: DataFrame, provider: str, model) -> DataFrame:
    """df with ok and message for each row's provider: model(provider) is called once, and what it raises is data."""

    def one(p: str | None) -> tuple:
        try:
            model(p or "")
            return True, ""
        except Exception as e:  # noqa: BLE001  whatever a client raises
            return False, str(e)

    def run(providers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in providers], columns=["ok", "message"])

    return df.withColumn("_test", F.pandas_udf(run, "ok boolean, message string")(F.col(provider))).select(*df.columns, "_test.*")
