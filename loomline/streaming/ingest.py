"""Incremental ingestion and a rate limit on a stream."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators import ingest
from ..sources.parsers import extension, parsed


def ingest_folder(spark: SparkSession, landing: str, out: str, checkpoint: str, embedder=None) -> StreamingQuery:
    """Ingests the files that lie in a folder, each once: a document row with its status under out/documents, vectors under out/vectors.

    A batch is written by its number, so one that runs again after a failure overwrites what it wrote. Files are parsed
    and chunked once, under out/chunked, from which both tables are made.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(landing)
    name = F.element_at(F.split("path", "/"), -1)
    docs = files.select(name.alias("file_name"), F.col("length").alias("file_size"), "content").withColumn("doc_id", F.md5("file_name")).withColumn("file_type", extension(F.col("file_name")))
    docs = docs.withColumn("p", parsed(F.col("content"), F.col("file_type"))).select("doc_id", "file_name", "file_type", "file_size", "p.text", "p.error")

    def write(batch: DataFrame, number: int) -> None:
        ingest.processed(batch).drop("text", "error").write.mode("overwrite").parquet(f"{out}/chunked/batch={number}")
        done = spark.read.parquet(f"{out}/chunked/batch={number}")
        done.drop("chunks").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        ingest.vectors(done, embedder).write.mode("overwrite").parquet(f"{out}/vectors/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited_stream(hits: DataFrame, keys: list[str], micros: str, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """A stream's hits with how many lie in the window that ends with each, as `operators.limits.sliding_window` has it.

    The state of a key are its times within the window, and it goes when the watermark, `late` behind the
    newest hit, has passed them. Hits of a batch are taken in the order of their times; one that is older
    than those seen before counts what the state still holds.
    """
    span = seconds * 1_000_000
    types = dict(hits.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{micros} long", "hits long", "denied boolean"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = sorted(state.get[0]) if state.exists else []
        new = sorted({int(t) for pdf in batches for t in pdf[micros]} - set(seen))
        rows, first = [], 0  # times are in order; those before `first` have left the window
        for t in new:
            first = bisect_right(seen, t - span, lo=first)
            insort(seen, t, lo=first)
            rows.append((*key, t, len(seen) - first, len(seen) - first > limit))
        seen = seen[first:]
        state.update((seen,))
        state.setTimeoutTimestamp(max((max(seen) + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=[*keys, micros, "hits", "denied"])

    timed = hits.withColumn("_at", F.timestamp_micros(F.col(micros))).withWatermark("_at", late)
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "times array<long>", "append", "EventTimeTimeout")


def hits_per_window(hits: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Hits of a stream by window and key; rows over `late` behind are left out."""
    return hits.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
