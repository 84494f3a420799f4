"""SimHash near-dedup: fingerprints, a binary-trie self-join on them, and components.

A fingerprint's 64 bits are the path to it in a binary trie. The self-join walks
pairs of trie nodes at once, adds the bits in which the two paths differ, and
drops a pair as soon as they exceed the radius. To deal the walk over a cluster,
radius + 1 tries are built, each over the bits rotated so that another block
leads: two fingerprints within the radius agree on at least one block, so that
in its trie the walk may start at a node's pair with itself, and each such node
is a task of its own. A node with over max_node fingerprints is taken eight
levels down in Spark, as pairs of its descendants that the radius still allows,
until every pair of nodes is small. Texts with one fingerprint are one entry
throughout, whatever their number. Links of a node leave it as a star (at most
one row a fingerprint); components come of large-star and small-star rounds on
these, with the lineage cut after each.

Defined results: null or empty text and text without a word have fingerprint 0;
a null doc_id never names a component unless all its members are null; repeated
rows are kept, each with its component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_key, texts, unused, written

#: Words to a shingle, differing bits that still link, fingerprints to a node that one task walks.
SHINGLE, RADIUS, MAX_NODE = 3, 2, 4096
_SEED = 42
_BLOCK = 100_000  # shingles or links looked at together


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's shingles, each weighing as often as it occurs."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) < size:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
        n = len(words) - size + 1
    h64, ones, left = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    while left:
        k = min(left, _BLOCK)
        h = np.fromiter((h64(g, _SEED) for g, _ in zip(grams, range(k))), np.uint64, k)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        left -= k
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_key and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Where each of radius + 1 blocks of the 64 bits begins, and its width."""
    n = radius + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def walk_pairs(bits: np.ndarray, depth: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, err: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie self-join: positions i < j in bits that differ in at most radius bits.

    bits: sorted within each node. A node pair is [lo, mid) and [mid, hi), or one
    node with itself where mid equals lo; depth: levels that lie above; err: bits
    in which the paths to the two nodes differ. All pairs go down a level at a time.
    """
    found = []
    frontier = [np.empty(0, np.int64)] * 5
    for level in range(int(depth.min(initial=64)), 64):
        new = depth == level
        same = new & (mid == lo)
        cross = new & (mid > lo)
        parts = [frontier, [lo[same], hi[same], lo[same], hi[same], err[same]], [lo[cross], mid[cross], mid[cross], hi[cross], err[cross]]]
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*parts))
        # Two single fingerprints need no further walk.
        single = (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 != b0)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= radius
            found.append((i[near], j[near]))
            a0, a1, b0, b1, e = (x[~single] for x in (a0, a1, b0, b1, e))
        if len(a0):
            bit = ((bits >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(bit)])
            am, bm = a1 - (sums[a1] - sums[a0]), b1 - (sums[b1] - sums[b0])  # zeros come first in a node
            own = a0 == b0
            other = ~own
            kids = [
                (a0, am, b0, bm, e),
                (am, a1, bm, b1, e),
                (a0, am, bm, b1, e + 1),
                (am[other], a1[other], b0[other], bm[other], e[other] + 1),
            ]
            a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*kids))
            live = (a1 > a0) & (b1 > b0) & (e <= radius) & ~((a0 == b0) & (a1 - a0 == 1))
            a0, a1, b0, b1, e = (x[live] for x in (a0, a1, b0, b1, e))
        frontier = [a0, a1, b0, b1, e]
    a0, _, b0, _, _ = frontier  # at the leaves: distinct fingerprints, one to a leaf
    found.append((a0[a0 != b0], b0[a0 != b0]))
    leaves = (depth == 64) & (mid > lo)
    found.append((lo[leaves], mid[leaves]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the least one that the links join it to."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, len(i), _BLOCK):  # a crowded node has millions of links: not all of them as Python integers at once
        for x, y in zip(i[at : at + _BLOCK].tolist(), j[at : at + _BLOCK].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], np.int64)


def _walked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (r, d, a, b, turned, fp) come sorted: node pairs follow one another. Those of a batch are walked together."""

        def links(t: dict[str, np.ndarray]) -> pa.RecordBatch:
            task = np.stack([t[c] for c in ("r", "d", "a", "b")], 1)
            starts = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1]) if len(task) else np.empty(0, np.int64)
            lo, hi = starts, np.append(starts[1:], len(task)) if len(task) else starts
            bits = t["turned"].view(np.uint64)
            d, a, b = (t[c][starts] for c in ("d", "a", "b"))
            in_a = (bits >> (np.uint64(64) - t["d"].astype(np.uint64))).view(np.int64) == t["a"]
            sums = np.concatenate([[0], np.cumsum(in_a)])
            mid = np.where(a == b, lo, lo + sums[hi] - sums[lo])
            i, j = walk_pairs(bits, d, lo, mid, hi, np.bitwise_count(a ^ b).astype(np.int64), radius)
            root = _stars(len(bits), i, j)
            child = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(t["fp"][child]), pa.array(t["fp"][root[child]])], names=["u", "v"])

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: np.asarray(batch.column(c), np.int64) for c in ("r", "d", "a", "b", "turned", "fp")}
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            last = np.flatnonzero(np.any([t[c] != t[c][-1] for c in ("r", "d", "a", "b")], axis=0))
            cut = last[-1] + 1 if len(last) else 0  # the last node pair may go on in the next batch
            held = {c: x[cut:] for c, x in t.items()}
            if cut:
                yield links({c: x[:cut] for c, x in t.items()})
        if held is not None:
            yield links(held)

    return run


def _masks(bits: int, most: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= most]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, max_node: int = MAX_NODE, step: int = 8) -> DataFrame:
    """Links (u, v) that join fingerprints within the radius: not all pairs, but enough that components are whole.

    fps: column fp, distinct.
    """
    if radius == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    tries = []
    for r, (at, width) in enumerate(_blocks(radius)):
        turned = F.col("fp") if at == 0 else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at))
        tries.append(F.struct(F.lit(r).cast("long").alias("r"), F.lit(width).cast("long").alias("d"), turned.alias("turned")))
    rows = fps.select("fp", F.explode(F.array(*tries)).alias("t")).select("fp", "t.*")
    prefix = F.expr("shiftrightunsigned(turned, cast(64 - d as int))")
    rows = rows.withColumn("a", prefix).withColumn("b", F.col("a"))
    key, small = ["r", "d", "a", "b"], None
    while True:
        # A pair of nodes counts if either holds a fingerprint, a node with itself if it holds two.
        n_a = F.sum(F.when(prefix == F.col("a"), 1).otherwise(0))
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), n_a.alias("n_a")).filter((F.col("n") > 1) & ((F.col("a") == F.col("b")) | F.col("n_a").between(1, F.col("n") - 1)))
        sizes = checkpointed(sizes.select(*key, "n"))
        large = (F.col("n") > max_node) & (F.col("d") < 64)
        fit = rows.join(sizes.filter(~large).drop("n"), key)
        small = fit if small is None else small.unionByName(fit)
        if sizes.filter(large).isEmpty():
            break
        # Down by some levels: each fingerprint's own descendant with those of the other node that the radius allows.
        k = F.least(F.lit(step), 64 - F.col("d").cast("int"))
        hot = checkpointed(rows.join(sizes.filter(large).drop("n"), key).withColumn("k", k.cast("int")))
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(step, radius)])
        hot = hot.withColumn("own", F.expr("shiftrightunsigned(turned, cast(64 - d - k as int))")).withColumn("p", prefix)
        hot = hot.withColumn("peer", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        hot = hot.withColumn("mask", F.explode(masks)).filter(F.expr("bit_count(mask) + bit_count(a ^ b)") <= radius).filter(F.expr("mask < shiftleft(1L, k)"))
        other = F.expr("shiftleft(peer, k) | ((own & (shiftleft(1L, k) - 1)) ^ mask)")
        hot = hot.withColumn("other", other)
        rows = hot.select("fp", "r", (F.col("d") + F.col("k")).alias("d"), "turned", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    dealt = small.select(*key, "turned", "fp").repartition(*key)
    # Within a node pair: first the rows below a, then those below b, in the order of the trie.
    order = [*key, F.when(prefix == F.col("a"), 0).otherwise(1), F.expr("turned ^ shiftleft(1L, 63)")]
    return dealt.sortWithinPartitions(*order).mapInArrow(_walked(radius), "u long, v long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root for every node of links (u, v): the least node that the links reach.

    Large-star and small-star rounds: links only ever move to smaller nodes, until all are stars.
    """
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = checkpointed(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(pairs.select("u", F.col("m").alias("v")))
        e = checkpointed(small.filter("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, max_node: int = MAX_NODE) -> DataFrame:
    """doc_id, row_key, fp, component_id (the least doc_id of all that links reach) and kept_key (that document's row_key) for every row of docs."""
    fps = written(fingerprints(docs, size), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    entries = written(fps.groupBy("fp").agg(first.alias("first")), "fingerprint-entries")
    comp = components(fingerprint_links(entries.select("fp"), radius, max_node))
    rooted = checkpointed(entries.join(comp, entries.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    of = rooted.join(least, "root").select("fp", "least")
    return fps.join(of, "fp").select("doc_id", "row_key", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("kept_key"))


def without_copies(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that rows (doc_id, row_key, kept_id, kept_key) doesn't name as kept; of whole repeated rows one stays."""
    rows = written(rows, "near-duplicates")
    gone = ~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")))
    row, lost_id, lost_row = unused(docs, "row", "lost_id", "lost_row")
    losers = rows.filter(gone).select(F.col("doc_id").alias(lost_id), F.col("row_key").alias(lost_row)).distinct()
    out = docs.withColumn(row, row_key()).join(losers, F.col("doc_id").cast("long").eqNullSafe(F.col(lost_id)) & (F.col(row) == F.col(lost_row)), "left_anti")
    # Only if a document is there twice, whole, must rows be told apart further.
    if not rows.filter(~gone).groupBy("doc_id", "row_key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", row])
    return out.select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (of several such rows, that of the least row_key)."""
    rows = near_duplicates(docs, size, radius)
    return without_copies(docs, rows.select("doc_id", "row_key", F.col("component_id").alias("kept_id"), "kept_key"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
