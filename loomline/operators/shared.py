"""Intermediate tables in the folder that the cluster shares: safe from lost executors, of known size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); in local mode one of our own, if none is named."""
    sc = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared(spark).rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the cluster's shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in folders by the columns named."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that holds whole texts or vectors, and its bytes (a longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to a size at which batches of texts or vectors are small in a Python worker, however long these are; lower settings stay."""
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows, "10000")) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if not 0 < df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(size, "64m")) <= BATCH_BYTES:
        conf.set(size, BATCH_BYTES)
    return df
