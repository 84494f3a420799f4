"""Line dedup: drop lines that many documents share.

Keys of lines are hashed to 128 bits, range-partitioned by (hash, document
descending) and sorted by position within; a stream over each partition keeps
the first document of every run and drops the lines of the others. Ranges cut
between the documents of one hash, so a line that a third of all documents hold
is dealt over many tasks; what a task must know of a run that began or ends in
another task are two short rows a partition. The result of the search is a
compressed keep bitmap per document, and only documents that lose a line have
one; texts are touched once more, when a bitmap is applied.

Defined results: null or empty text is one empty line; a null doc_id is the
smallest of all; rows that repeat a doc_id count as one document, each keeps its
own lines; keys shorter than min_chars never drop; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_key, texts, unused, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Stripped at both ends of a line.
SPACE = " \t\n\x0b\f\r"

_KEYS = "h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"


def line_key(line: str) -> str:
    """A line without white space at its ends, A-Z as a-z."""
    return line.strip(SPACE).encode().lower().decode()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each line whose key has min_chars code points: its hash, document and position."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                lines = (text or "").split("\n")
                for pos, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars:
                        digests.append(hashlib.blake2b(key.encode().lower(), digest_size=16).digest())
                        at.append((i, pos, len(lines)))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            a = np.array(at, dtype=np.int32).reshape(-1, 3)
            rows = pa.array(a[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(a[:, 1]), pa.array(a[:, 2])],
                names=["h1", "h2", "doc_id", "row_key", "pos", "n_lines"],
            )

    source = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    return source.mapInArrow(keys, _KEYS)


_EDGES = "pid int, h1 long, h2 long, docs long, head boolean, tail boolean"


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last run of a partition: hash and number of documents."""
    from pyspark import TaskContext

    pid, runs = TaskContext.get().partitionId(), []  # of [hash, documents], the first and the last
    run = doc = None
    for pdf in batches:
        for h1, h2, d in zip(pdf["h1"].tolist(), pdf["h2"].tolist(), pdf["doc_id"].tolist(), strict=True):
            if (h1, h2) != run:
                run, doc = (h1, h2), None
                runs = [*runs[:1], [run, 0]]
            if d != doc:
                doc = d
                runs[-1][1] += 1
    rows = [(pid, *hashed, docs, i == 0, i == len(runs) - 1) for i, (hashed, docs) in enumerate(runs)]
    yield pd.DataFrame(rows, columns=["pid", "h1", "h2", "docs", "head", "tail"])


def _carried(edges: list) -> dict[int, tuple[tuple, int, tuple, int]]:
    """For each partition: the hash of its first run and the documents of that run in earlier partitions, and the like for its last run and later ones."""
    before: dict[int, tuple] = {}
    after: dict[int, tuple] = {}
    edges = sorted(edges, key=lambda e: (e.pid, not e.head))
    for order, to, mine, other in ((edges, before, "head", "tail"), (edges[::-1], after, "tail", "head")):
        run, docs = None, 0
        for e in order:
            key = (e.h1, e.h2)
            if getattr(e, mine):
                to[e.pid] = (key, docs if key == run else 0)
            if getattr(e, other):
                docs = (docs if key == run and getattr(e, mine) else 0) + e.docs
                run = key
    return {p: (*before[p], *after[p]) for p in before}


def _drops(carried: dict, min_docs: int):
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by hash and, within it, from the largest document down. Of a run at most min_docs - 2 documents wait."""
        from pyspark import TaskContext

        head, before, tail, after = carried.get(TaskContext.get().partitionId(), (None, 0, None, 0))
        run = doc = None
        seen = later = 0
        wait: list[tuple] = []
        for pdf in batches:
            out = []
            for h1, h2, d, *row in zip(*(pdf[c].tolist() for c in ("h1", "h2", "doc_id", "row_key", "pos", "n_lines")), strict=True):
                if (h1, h2) != run:
                    run, doc, wait = (h1, h2), None, []
                    seen, later = before if run == head else 0, after if run == tail else 0
                if d != doc:
                    doc = d
                    seen += 1
                if seen == 1:
                    continue
                wait.append((d, *row))
                if seen + later >= min_docs:
                    out += wait
                    wait = []
            yield pd.DataFrame(out, columns=["doc_id", "row_key", "pos", "n_lines"])

    return stream


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Columns doc_id, row_key, n_dropped and keep (zlib of a bit per line, 1: stays) for each row that loses a line.

    A key in at least min_docs documents loses its lines in all but the largest doc_id.
    """
    keys = written(line_keys(docs, min_chars), "line-keys")
    # A null doc_id sorts as the smallest; a long can't be lower than the stand-in.
    keys = keys.withColumn("was_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    by = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    dealt = checkpointed(keys.repartitionByRange(*by).sortWithinPartitions(*by, "pos"))
    carried = _carried(dealt.mapInPandas(_edges, _EDGES).collect())  # two rows a partition at most
    dropped = dealt.select("h1", "h2", "doc_id", "row_key", "pos", "n_lines").mapInPandas(_drops(carried, min_docs), "doc_id long, row_key long, pos int, n_lines int")

    @F.pandas_udf("binary")
    def bitmap(pos: pd.Series, n_lines: pd.Series) -> pd.Series:
        def one(p: np.ndarray, n: int) -> bytes:
            keep = np.ones(n, bool)
            keep[p] = False
            return zlib.compress(np.packbits(keep).tobytes())

        return pd.Series([one(p, n) for p, n in zip(pos, n_lines, strict=True)], dtype=object)

    # Equal rows of documents hold the same positions: they share one bitmap.
    per_doc = dropped.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("pos")).alias("pos"), F.max("n_lines").alias("n_lines"))
    return per_doc.select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "row_key", F.size("pos").cast("long").alias("n_dropped"), bitmap("pos", "n_lines").alias("keep")
    )


def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines that a bitmap keeps."""

    def one(t: str | None, k: bytes | None) -> str | None:
        if t is None or k is None:
            return None
        lines = t.split("\n")
        return "\n".join(line for line, on in zip(lines, np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8)), strict=False) if on)

    return pd.Series([one(t, k) for t, k in zip(text, keep, strict=True)], dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, into: tuple[str, str] = ("ll_n_lines", "ll_n_dropped")) -> DataFrame:
    """docs with the lines that stay in `text`, and how many lines there were and how many went. Columns called as `into` says are replaced; a caller that has such columns names others.

    Spark broadcasts the bitmaps if their table is small by its own threshold, and joins by shuffle otherwise.
    """
    docs = docs.drop(*into)
    row, b_id, b_row, gone, keep = unused(docs, "row", "b_id", "b_row", "gone", "keep")
    b = written(bitmaps, "keep-bitmaps").select(F.col("doc_id").alias(b_id), F.col("row_key").alias(b_row), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    old = F.coalesce(F.col("text"), F.lit(""))
    joined = texts(docs).withColumn(row, row_key()).join(b, F.col("doc_id").eqNullSafe(F.col(b_id)) & (F.col(row) == F.col(b_row)), "left")
    out = joined.select(
        *[c for c in docs.columns if c != "text"],
        F.coalesce(F.pandas_udf(_kept, "string")(F.when(F.col(keep).isNotNull(), F.col("text")), F.col(keep)), F.col("text")).alias("text"),
        (F.length(old) - F.length(F.replace(old, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(into[0]),
        F.coalesce(gone, F.lit(0)).cast("long").alias(into[1]),
    )
    return out.select(*docs.columns, *into)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, into: tuple[str, str] = ("ll_n_lines", "ll_n_dropped")) -> DataFrame:
    """docs without the lines that repeat across documents (see apply_bitmaps)."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs), into)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("ll_n_lines").alias("n_lines"), F.col("ll_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op6_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), many as (
  select k, max(doc_id) as top from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), judged as (
  select doc_id, pos, line, (many.k is not null and doc_id <> top) as gone from keyed left join many using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
""",
}
