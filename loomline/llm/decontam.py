"""Benchmark decontamination: documents that hold a passage of a benchmark item. DataFrame operations only.

Words are runs of letters and digits in lower case, shingles are five words. A
window of a document with the size of an item can only reach the similarity if
enough of its places hold shingles of items of that size; all windows for which
that holds are taken, wherever they start (nothing can be lost: what a window has
in common with an item is at most the number of such places). So windows come of an
exact join on shingles with a bound that loses none; SimHash and its index then
say which items each is held against. Each window and each item has a SimHash of
its weighted shingles (weight: occurrences). Fingerprints within the radius are found by
multi-index hashing: of four blocks of sixteen bits at least one differs in no
more than radius / 4 bits, so the items are entered under every such value of
each block (2788 rows an item), the windows look up their own values, and all
pairs within the radius meet. Of unrelated pairs 1 in 24 meets. Only keys and
fingerprints go through the index; the shingles of a window join its candidates
behind the Hamming filter, to be verified by the exact weighted Jaccard similarity.

At 0.8 two fingerprints differ in about 10 of 64 bits with a deviation of 3; the
radius of 15 takes 99.4 % of pairs between 0.8 and 1 as measured on edited copies,
and a passage that is missed at one window is mostly met at the next.

The corpus is read twice, the second time only for documents with a window; its
texts are shuffled only if the keys of these outgrow a broadcast by Spark's own
measure. The index is written before it is joined, for the same reason. A document stays one row: common passages fill no task.

Defined results: null and empty texts match nothing; nor do items of fewer than
five words, which have no shingle and would match ordinary sentences: `too_short`
lists them; an item longer than a document is compared to the whole
document; repeated rows give one row; of equally similar windows the first
counts; a null doc_id is kept; columns of docs may have any names; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, unused, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(word_array: str, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    return F.expr(f"case when size({word_array}) < {size} then array() else transform(sequence(1, size({word_array}) - {size - 1}), i -> xxhash64(slice({word_array}, i, {size}))) end")


def simhash(hashes: str) -> Column:
    """64-bit fingerprint of an array of hashes: a bit is that of more than half of them."""
    bits = "".join(f"(case when 2 * size(filter({hashes}, h -> (h & {1 << i if i < 63 else -(1 << 63)}L) <> 0)) > size({hashes}) then {1 << i}L else 0L end) | " for i in range(63))
    return F.expr(bits + f"(case when 2 * size(filter({hashes}, h -> h < 0)) > size({hashes}) then shiftleft(1L, 63) else 0L end)")


def _near(block_bits: int, radius: int) -> list[int]:
    return [m for m in range(1 << block_bits) if m.bit_count() <= radius]


def item_index(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """item_id, n_words, hashes, counts (hash -> occurrences) and fp of each item with a shingle."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") >= size).select("item_id", F.size("w").alias("n_words"), shingles("w", size).alias("hashes"))
    counts = F.expr("map_from_entries(transform(array_distinct(hashes), h -> struct(h, size(filter(hashes, x -> x = h)))))")
    return items.withColumn("counts", counts).withColumn("fp", simhash("hashes"))


def too_short(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """item_id and n_words of the items that have no shingle and can't be searched for."""
    items = benchmark.select("item_id", F.size(words(F.col("text"))).alias("n_words"))
    return items.filter(F.col("n_words") < size)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, item_id, start_word, n_words, similarity and hamming of the best window of each document and item that match."""
    items = written(item_index(benchmark, size), "items")
    width = 64 // BLOCKS
    # The shingles of items of a size.
    marks = items.select("n_words", F.explode("hashes").alias("hash")).distinct()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    hashed = source.select("doc_id", "row_key", words(F.col("text")).alias("w")).select("doc_id", "row_key", F.size("w").alias("doc_words"), shingles("w", size).alias("hashes"))
    # Outer: else Spark filters by the array's size first, and for that computes the words of a text anew at each shingle.
    places = hashed.select("doc_id", "row_key", "doc_words", F.posexplode_outer("hashes").alias("p", "hash")).join(marks, "hash")
    per_size = places.groupBy("doc_id", "row_key", "doc_words", "n_words").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # A window can only be similar enough if this many of its places hold a shingle of an item.
    per_size = per_size.withColumn("m", F.col("n_words") - (size - 1)).withColumn("win_size", F.least("m", F.col("doc_words") - (size - 1)))
    per_size = per_size.withColumn("need", F.greatest(F.lit(1), F.ceil(similarity * (F.col("win_size") + F.col("m")) / (1 + similarity) - 1e-9)).cast("int"))
    # Of the windows whose first such place is the i-th: all starts that take in enough further ones.
    lo = "greatest(0, if(i > 0, ps[greatest(i - 1, 0)] + 1, 0), ps[i + need - 1] - win_size + 1)"
    hi = "least(ps[i], greatest(0, doc_words - n_words))"
    runs = f"transform(sequence(0, size(ps) - need), i -> if({lo} <= {hi}, sequence({lo}, greatest({lo}, {hi})), cast(array() as array<int>)))"
    starts = per_size.filter(F.size("ps") >= F.col("need")).select("doc_id", "row_key", "n_words", F.explode(F.flatten(F.expr(runs))).alias("start"))
    places = written(starts.distinct(), "windows")

    # The texts once more, only of documents with a window: their keys are a small table, which Spark broadcasts by its own measure.
    hits = written(places.select(F.col("doc_id").alias("p_id"), F.col("row_key").alias("p_key")).distinct(), "documents-with-windows")
    again = source.join(hits, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row_key") == F.col("p_key")), "left_semi")
    again = again.select("doc_id", "row_key", words(F.col("text")).alias("w")).select("doc_id", "row_key", shingles("w", size).alias("hashes"))
    per_doc = places.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("n_words", "start")).alias("at")).select(F.col("doc_id").alias("p_id"), F.col("row_key").alias("p_key"), "at")
    again = again.join(per_doc, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("row_key") == F.col("p_key")))
    windows = again.select("doc_id", "row_key", "hashes", F.explode_outer("at").alias("x")).select("doc_id", "row_key", "x.n_words", "x.start", F.expr(f"slice(hashes, x.start + 1, x.n_words - {size - 1})").alias("win"))
    key = ["doc_id", "row_key", "n_words", "start"]
    windows = written(windows.dropDuplicates(key).withColumn("fp", simhash("win")), "window-fingerprints")

    blocks = lambda fp: F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> cast(shiftrightunsigned({fp}, b * {width}) & {(1 << width) - 1} as int))")
    near = F.array(*[F.lit(m) for m in _near(width, radius // BLOCKS)])
    entries = items.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.posexplode(blocks("fp")).alias("block", "value"))
    entries = entries.select("item_id", "n_words", "item_fp", "block", F.explode(F.transform(near, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    entries = written(entries, "item-index")  # so that Spark knows how large it has grown
    probes = windows.select(*key, "fp", F.posexplode(blocks("fp")).alias("block", "value"))
    # A pair may meet in several blocks; the first of these speaks for it.
    first = F.expr(f"array_position(transform(sequence(0, {BLOCKS - 1}), b -> bit_count(shiftrightunsigned(fp ^ item_fp, b * {width}) & {(1 << width) - 1}) <= {radius // BLOCKS}), true) - 1")
    hamming = F.expr("bit_count(fp ^ item_fp)")
    pairs = probes.join(entries, ["n_words", "block", "value"]).filter((hamming <= radius) & (F.col("block") == first)).select(*key, "item_id", hamming.alias("hamming"))

    known = items.select(F.col("item_id").alias("i_id"), F.size("hashes").alias("n_item"), "counts")
    own = windows.select(*[F.col(c).alias(f"w_{c}") for c in key], "win")
    same = F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("row_key") == F.col("w_row_key")) & (F.col("n_words") == F.col("w_n_words")) & (F.col("start") == F.col("w_start"))
    both = pairs.join(own, same).join(known, F.col("item_id").eqNullSafe(F.col("i_id")))
    common = F.expr("aggregate(array_distinct(win), 0, (acc, h) -> acc + least(coalesce(element_at(counts, h), 0), size(filter(win, x -> x = h))))")
    both = both.withColumn("common", common)
    both = both.withColumn("similarity", F.col("common") / (F.size("win") + F.col("n_item") - F.col("common"))).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct(F.col("start").alias("start_word"), "n_words", "similarity", "hamming"), F.struct("similarity", -F.col("start"))).alias("best")
    return both.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "row_key", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold a benchmark passage."""
    row, hit_id, hit_row = unused(docs, "row", "hit_id", "hit_row")
    found = contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias(hit_id), F.col("row_key").alias(hit_row)).distinct()
    return docs.withColumn(row, row_key()).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(hit_id)) & (F.col(row) == F.col(hit_row)), "left_anti").select(*docs.columns)


def op9_decontam(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark).select("doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity"))


ORACLE = {
    "op9_decontam": r"""
with w as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from (select distinct doc_id, text from documents)
  union all
  select 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') from benchmark
), sh as (
  select side, id, len(ws) as n, unnest(range(0, len(ws) - 4)) as p, ws from w where len(ws) >= 5
), s as (
  select side, id, n, p, array_to_string(ws[p + 1 : p + 5], ' ') as g from sh
), pair as (
  -- a document and an item with nothing in common have similarity 0; of the others all windows are looked at
  select distinct d.id as doc_id, i.id as item_id, d.n as d_n, i.n as n_words from s d join s i on d.side = 'd' and i.side = 'i' and d.g = i.g
), start as (
  select distinct doc_id, n_words, unnest(range(0, greatest(1, d_n - n_words + 1))) as start_word from pair
), win as (
  select t.doc_id, t.n_words, t.start_word, s.g, count(*) as k
  from start t join s on s.side = 'd' and s.id = t.doc_id and s.p between t.start_word and t.start_word + t.n_words - 5
  group by all
), size_w as (
  select doc_id, n_words, start_word, sum(k) as n_win from win group by all
), item as (
  select id as item_id, n as n_words, g, count(*) as k from s where side = 'i' group by all
), size_i as (
  select item_id, sum(k) as n_item from item group by all
), both_ as (
  select win.doc_id, item.item_id, win.n_words, win.start_word, sum(least(win.k, item.k)) as common
  from win join item on win.n_words = item.n_words and win.g = item.g group by all
), scored as (
  select b.*, common / (n_win + n_item - common) as similarity
  from both_ b join size_w using (doc_id, n_words, start_word) join size_i using (item_id)
)
select doc_id, item_id, start_word::int as start_word, n_words::int as n_words, round(similarity, 6) as similarity
from (select *, row_number() over (partition by doc_id, item_id order by similarity desc, start_word) as r from scored where similarity >= 0.8)
where r = 1
""",
}
