"""Target-distribution importance resampling: documents drawn so that hashed n-grams look like the target's.

A streaming ring of CRC states gives the n-grams: one scan of a document's words
keeps, for each of the last n starts, the zlib state of the run that began there;
a new word extends every state by a space and the word, and each state is then the
checksum of one run. So no n-gram is ever put together, and a word's bytes are read
once a start. The scan emits buckets only, two bytes a feature, which are written;
counts and weights are made of that table and not of the texts again.

Bucket counts of a task are added up in it before Spark adds up those of all tasks.
What goes to every task is a gain a bucket. Weights plus Gumbel noise of the
document's id are ranked by ranges of the score, so no task sees all documents; the
highest ones are a draw without replacement by weight.

Defined results: null and empty text and text without a word have no feature and
weight 0; documents with fewer than least_words words are never drawn; ties go to
the smaller doc_id, and a null doc_id (which has the noise of an empty id) after
all others; repeated rows are documents of their own; an empty target counts
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.ranks import Ranked

from .common import texts, written

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: After lowering A-Z: every byte but ASCII punctuation, space and control codes. Bytes of other letters are 0x80 and up.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def crc_ring(words: list[bytes], longest: int) -> Iterator[int]:
    """Checksums of all runs of 1 to `longest` consecutive words joined by a space: at each word those that end in it, the longest run first."""
    ring: deque[int] = deque(maxlen=longest)
    for word in words:
        if len(ring) == longest:
            ring.popleft()
        spaced = b" " + word
        for i, state in enumerate(ring):
            ring[i] = zlib.crc32(spaced, state)
        ring.append(zlib.crc32(word))
        yield from ring


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and buckets (little-endian numbers of two bytes, or four if there are more than 65,536 buckets) of rows (doc_id, text)."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, found = [], [], []
            for text in batch.column(1):
                own = words(text.as_py())
                n = sum(max(0, len(own) - k) for k in range(longest))
                got = np.fromiter(crc_ring(own, longest) if longest > 1 else map(zlib.crc32, own), np.uint32, n)
                n_words.append(len(own))
                n_features.append(n)
                found.append((got % np.uint32(buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n (features in it) of all rows (buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket: floor(1000 ln of the share of the target's features over that of the source's), each count plus one. source, target: bucket and n."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    counts = both.toPandas().sort_values("bucket")  # a row a bucket
    s, t = (counts[c].to_numpy(np.int64) for c in "st")
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.floor(1000 * np.log((t + 1.0) * total_s / ((s + 1.0) * total_t))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of all features) of rows as `bucketed`."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(own, kind)].sum()) for own in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Gumbel noise of a document's id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text). rank: from 1 for the documents drawn, else null. target: column text."""
    rows = written(bucketed(docs, longest, buckets), "buckets")
    aim = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets), buckets)
    scored = weighed(rows, gain).withColumn("score", (F.col("weight") + noise("doc_id", seed)).cast("long"))
    draw = percent * rows.filter(F.col("n_words") >= least_words).count() // 100
    # Those that may be drawn come first; equal rows are dealt over ranges by where they were read.
    ranked = Ranked(scored.select("*", (F.col("n_words") < least_words).alias("short"), F.monotonically_increasing_id().alias("read")), "short", F.desc("score"), F.asc_nulls_last("doc_id"), "read").rows
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs.select("doc_id", "text"), benchmark.select("text"))


ORACLE = {
    "op13_importance": rf"""
with entry as (
  select list_reduce(list_concat([i], range(8)), lambda c, j: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) as v, i from range(256) r(i)
), crc_table as (
  select list(v order by i) as t from entry
), w as materialized (
  select side, id, unnest(ws) as w from (
    select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from (select 's' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark)
  )
), bytes as (
  select w, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint) as b from (select w, hex(encode(w)) as h from (select distinct w from w))
), crc as materialized (
  -- four bytes of 255 begin and end a checksum; here the start value is the first of the list
  select w, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from bytes, crc_table
), n as (
  select bucket, count(*) filter (side = 's') as s, count(*) filter (side = 't') as t from w join crc using (w) group by bucket
), total as (
  select sum(s) as s, sum(t) as t from n
), gain as (
  select bucket, floor(1000 * ln((n.t + 1)::double * (total.s + {BUCKETS})::double / ((n.s + 1)::double * (total.t + {BUCKETS})::double)))::bigint as gain from n, total
), weight as (
  select id, count(*) as n_features, sum(gain)::bigint as weight from w join crc using (w) join gain using (bucket) where side = 's' group by id
), scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents left join weight on id = doc_id
)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and r <= ({PERCENT} * n) // 100 then r end as rank from (
  select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id) as r, count(*) filter (n_features >= {LEAST_WORDS}) over () as n from scored
)
"""
}
