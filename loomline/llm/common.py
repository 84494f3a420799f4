"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loomline-")
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors, of known size. by: columns that are folders."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut; partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1000


def texts(df: DataFrame) -> DataFrame:
    """df, after lowering the session's Arrow batches to a size at which batches of whole texts are small; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, TEXT_ROWS)
    return df


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1. A null id: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
