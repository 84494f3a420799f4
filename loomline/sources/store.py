"""Tables that are upserted by bucket, several at once, and whose new rows become visible together.

A row lies in the bucket of a column's hash. An upsert reads and writes the buckets
that its rows touch, into a new folder (a generation) of each table; files of the
other buckets stay as they are. A manifest says which generation of each bucket is
live. It is written last, under the next number, by a rename that fails if that
number is there already: so readers see all tables before or after an upsert and
never between, a writer that dies leaves nothing that counts, and of two writers
at once one is told to try again.

Rows without a key are all kept. Generations that no manifest names any more stay on
disk until the store's folder is cleaned.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import replaced, upserted
from ..operators.shared import saved

BUCKETS = 64
#: Column of a bucket's number, which is a folder.
_BUCKET = "store_bucket"


class ConcurrentUpsert(RuntimeError):
    """Another writer has taken the next version; nothing of this one counts."""


class Store:
    """tables: name -> (key, column whose hash gives the bucket). A key keeps its value of that column."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def manifest(self) -> dict:
        """version (0: nothing yet) and tables: name -> schema and live (bucket -> generation)."""
        folder = self._at("manifests")
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        names = sorted(n for n in names if n.endswith(".json"))
        if not names:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['version']:012}.json"
        part, whole = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", name)
        fs = part.getFileSystem(self.conf)
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, whole, none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(part, False)
            raise ConcurrentUpsert(f"version {manifest['version']} is there already") from e

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """A table's live rows (of some buckets only); None before its first upsert."""
        of = (manifest or self.manifest())["tables"].get(table)
        if of is None:
            return None
        live = {b: g for b, g in of["live"].items() if buckets is None or int(b) in buckets}
        schema = self.spark.createDataFrame([], of["schema"]).schema
        if not live:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{table}/generation={g}/{_BUCKET}={b}" for b, g in sorted(live.items())]
        return self.spark.read.schema(schema).parquet(*folders)

    def upsert(self, changes: dict[str, DataFrame], how: str = "upsert") -> int:
        """Rows by table name; how: rows of the same key give way to new ones ("upsert", one row a key), or all rows with the same value of the bucket's column do, such as those of a document ("replace"). Returns the version."""
        if how not in ("upsert", "replace") or set(changes) - set(self.tables):
            raise ValueError("how is upsert or replace, and tables are those of the store")
        manifest = self.manifest()
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the store has {manifest['buckets']} buckets")
        generation = uuid.uuid4().hex
        for table, rows in changes.items():
            key, by = self.tables[table]
            of = manifest["tables"].setdefault(table, {"schema": rows.schema.simpleString(), "live": {}})
            if of["schema"] != rows.schema.simpleString():
                raise ValueError(f"{table} has other columns: {of['schema']}")
            bucket = F.coalesce(F.pmod(F.xxhash64(by), F.lit(self.buckets)), F.lit(0)).cast("int")
            # Written first: what makes the rows (an embedder, say) runs once.
            new = saved(rows, "upsert")
            touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets
            old = self.read(table, touched, manifest)
            merged = (upserted(old, new, key) if how == "upsert" else replaced(old, new, by)).withColumn(_BUCKET, bucket)
            # Ranges cut a large bucket into several files.
            merged.repartitionByRange(_BUCKET, F.xxhash64(key)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{table}/generation={generation}")
            of["live"] |= {str(b): generation for b in touched}
        manifest["version"] += 1
        self._commit(manifest)
        return manifest["version"]
