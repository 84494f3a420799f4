"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two finders propose pairs, and only the exact similarity links. First SimHash:
the fingerprints of the sets go through the binary-trie self-join of `simhash`,
which is cheap and groups the closest copies. But at a similarity of 0.8 two
fingerprints differ in 10 of 64 bits and up to 22, and no walk over so wide a
radius is short: with 11 errors allowed nearly all pairs of nodes stay alive for
the first twenty levels. So prefix filtering completes the links, and it loses
none: with the shingles of each text in one order, two sets that are this similar
share one of the first n - ceil(0.8 n) + 1 shingles of each. Sets that share such
a shingle are candidates if their sizes allow the similarity and their signatures
do: a signature is the parity of the hashes in each of 1024 cells (in as many as
the set has shingles, for long texts; folded to 1024 where blocks meet), and two sets differ in at least as many
shingles as their signatures differ in bits.

The order has the shingles that many texts share last, by how many, and the rest
by hash: passages that thousands of documents have in common then lie beyond the
prefixes of all of them. Which these are is read off the prefixes themselves: a
shingle in those of CROWD sets and more goes to the end of the order, and texts
that had one in their prefix get a new prefix; the others keep theirs, which the
new order gives just the same. Any order gives the same links, so that the bound
FREQUENT of shingles sent to the tasks costs time at most and never a link.

Texts with one set are one entry. Only of entries that share a prefix shingle with
another are signatures read, and only of pairs that these allow the texts. Where
up to SMALL sets share a shingle, pairs are made that their sizes and the
shingle's places allow. Where over LARGE do, a few rounds compare each entry with
one other, so that groups of near copies grow together from few comparisons. Only
then are the pairs of crowded shingles compared that are not in one group yet,
dealt by bands of size, since sets of sizes too far apart can't be similar, and by blocks within a
band; pairs that the filters reject never become rows.

Defined results: words are those of the fingerprints (ASCII space, A-Z in lower
case); a text of under five words is one shingle; texts without a word are copies
of each other; null text is empty; a null doc_id stays of a group only if all
its rows have none; repeated rows are one; columns of docs may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, discarded, row_key, texts, written
from .simhash import components, fingerprint_links, without_copies

SHINGLE, SIMILARITY, CELLS, BLOCK, ROUNDS = 5, 0.8, 1024, 512, 4
#: A shingle in the prefixes of more sets than this is crowded: signatures go along before its pairs are made.
SMALL = 16
#: And than this very crowded: rounds join its groups before its pairs are made.
LARGE = 64
#: Differing bits of fingerprints that the trie walk takes, and fingerprints to a node that one task walks: near copies crowd together.
RADIUS, MAX_NODE = 2, 1024
#: A shingle in the prefixes of CROWD sets counts as frequent; at most FREQUENT of them are sent to tasks, found in SETTLE rounds.
CROWD, FREQUENT, SETTLE = 512, 200_000, 1
_SEED = 42


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(size)))), len(words) - size + 1
    h64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h64(g, _SEED) for g in grams), np.uint64, n))


def _least(n: int, similarity: float) -> int:
    """ceil(similarity * n), for a similarity whose product is off by rounding only."""
    return math.ceil(similarity * n - 1e-9)


def _signature(hashes: np.ndarray) -> np.ndarray:
    """The parity of the hashes in each cell; as many cells as the set has shingles, rounded up to a power of two, CELLS at least."""
    cells = max(CELLS, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[at : at + 100_000].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def sketched(docs: DataFrame, similarity: float = SIMILARITY, frequent: np.ndarray | None = None) -> DataFrame:
    """doc_id, row_key, key (of the set), fp (SimHash), n, prefix and wide (signature) of each row. frequent: hashes that come last, in this order."""
    frequent = np.empty(0, np.uint64) if frequent is None else frequent
    by_hash = np.argsort(frequent).astype(np.int32)
    common = frequent[by_hash]

    def ordered(h: np.ndarray) -> np.ndarray:
        if not len(common):
            return h
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        shared = common[at] == h
        return np.concatenate([h[~shared], h[shared][np.argsort(by_hash[at[shared]])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            keys, fps, ns, prefixes, wide = [], [], [], [], []
            for text in batch.column(2):
                h = shingle_set(text.as_py())
                keys.append(xxhash.xxh64_intdigest(h.tobytes(), _SEED))
                fps.append(_simhash(h))
                ns.append(len(h))
                prefixes.append(ordered(h)[: len(h) - _least(len(h), similarity) + 1].view(np.int64))
                wide.append(_signature(h))
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, wide)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(ns, pa.int64()), *lists], names=["doc_id", "row_key", "key", "fp", "n", "prefix", "wide"])

    source = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    return source.mapInArrow(run, "doc_id long, row_key long, key long, fp long, n long, prefix array<long>, wide array<long>")


def texts_of(docs: DataFrame, entries: DataFrame, repeated: bool) -> DataFrame:
    """key, s_id and text of entries (key, row_key, doc_id), each named by a row of docs. repeated: whether docs has rows twice. entries should be written, so that Spark knows its size."""
    source = docs.select(F.col("doc_id").cast("long").alias("s_id"), row_key().alias("s_key"), "text")
    named = entries.select("key", F.col("row_key").alias("o_key"), F.col("doc_id").alias("o_id"))
    out = source.join(named, (F.col("s_key") == F.col("o_key")) & F.col("s_id").eqNullSafe(F.col("o_id"))).select("key", "s_id", "text")
    return out.dropDuplicates(["key"]) if repeated else out


def settled(docs: DataFrame, entries: DataFrame, repeated: bool, similarity: float = SIMILARITY, crowd: int = CROWD, most: int = FREQUENT, rounds: int = SETTLE) -> tuple[DataFrame, list[DataFrame]]:
    """key, n and prefix of entries (key, n, prefix, row_key, doc_id), in an order that has the crowded shingles last; and the tables made for it."""
    known = pd.DataFrame({"hash": pd.Series(dtype="int64"), "count": pd.Series(dtype="int64")})
    out, made = entries.select("key", "n", "prefix"), []
    for _ in range(rounds):
        sizes = out.select(F.explode("prefix").alias("hash")).groupBy("hash").count().filter(F.col("count") >= crowd)
        found = sizes.orderBy(F.desc("count"), "hash").limit(most).toPandas()
        new = found[~found["hash"].isin(known["hash"])].head(most - len(known))
        if not len(new):
            break
        known = pd.concat([known, new]).sort_values(["count", "hash"])
        frequent = known["hash"].to_numpy(np.int64).view(np.uint64)
        crowded = entries.sparkSession.createDataFrame(pa.table({"hash": new["hash"].to_numpy(np.int64)}))
        # As many rows as there are crowded shingles in prefixes; a key counts once.
        keys = out.select("key", F.explode("prefix").alias("hash")).join(F.broadcast(crowded), "hash").select("key").distinct()
        again = written(entries.select("key", "row_key", "doc_id").join(keys, "key"), "crowded-entries")
        # Only prefixes that change are written; the others are read where they are.
        fresh = written(sketched(texts_of(docs, again, repeated).select(F.col("s_id").alias("doc_id"), "text"), similarity, frequent).select("key", "n", "prefix"), "fresh-prefixes")
        out = out.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)
        made += [again, fresh]
    return out, made


def _sets(docs: DataFrame) -> DataFrame:
    """key and hashes of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # sets of long texts are as large as these
                part = batch.slice(at, 100)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "hashes"])

    return texts(docs).select("key", "text").mapInArrow(run, "key long, hashes array<long>")


def _block_pairs(similarity: float):
    far = (1 - similarity) / (1 + similarity)  # of all shingles of two sets, so many may be in one only
    deal = ("hash", "band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (hash, band, x, y, side, key, n, comp, home, sig) come sorted: those of a pair of blocks follow one another. Two guests of a band meet in their own."""

        def pairs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            task = np.stack([t[c] for c in deal], 1)
            starts = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1, [len(task)]])
            for lo, hi in zip(starts, starts[1:]):
                own = t["x"][lo] == t["y"][lo]
                mid = lo + int((t["side"][lo:hi] == 0).sum())
                for i in range(lo, hi if own else mid):
                    s = slice(i + 1, hi) if own else slice(mid, hi)
                    n, m = t["n"][i], t["n"][s]
                    j = np.flatnonzero((t["comp"][s] != t["comp"][i]) & ((t["home"][s] | t["home"][i]) == 1) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6))
                    if len(j):
                        j += s.start
                        j = j[np.bitwise_count(t["sig"][j] ^ t["sig"][i]).sum(axis=1, dtype=np.int64) <= far * (n + t["n"][j]) + 1e-6]
                    if len(j):
                        a, b = np.full(len(j), t["key"][i]), t["key"][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        names, held = (*deal, "side", "key", "n", "comp", "home"), None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: np.asarray(batch.column(c), np.int64) for c in names}
            t["sig"] = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)  # unsigned: else bits of the absolute value count
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            last = np.flatnonzero(np.any([t[c] != t[c][-1] for c in deal], axis=0))
            cut = last[-1] + 1 if len(last) else 0  # the last pair of blocks may go on in the next batch
            held = {c: v[cut:] for c, v in t.items()}
            if cut:
                yield from pairs({c: v[:cut] for c, v in t.items()})
        if held is not None:
            yield from pairs(held)

    return run


def _possible(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that the sizes and signatures of their sets allow."""
    ab = [entries.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"s{c}")) for c in "ab"]
    pairs = pairs.join(ab[0], "a").join(ab[1], "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    # Sizes are near each other: one signature has as many cells as the other or twice as many, and is folded then.
    for mine, other in (("sa", "sb"), ("sb", "sa")):
        half = f"cast(size({mine}) / 2 as int)"
        pairs = pairs.withColumn(mine, F.expr(f"if(size({mine}) > size({other}), zip_with(slice({mine}, 1, {half}), slice({mine}, {half} + 1, {half}), (x, y) -> x ^ y), {mine})"))
    bits = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)")
    pairs = pairs.withColumn("bits", bits).filter(F.col("bits") <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6)
    return pairs.select("a", "b", (F.col("bits") / (F.col("na") + F.col("nb"))).alias("apart"))


def shared_shingles(prefixes: DataFrame, similarity: float = SIMILARITY, small: int = SMALL, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """key, n, hash, short and crowded of the shingles that several of prefixes (key, n, prefix) share. crowded: 0 for up to `small` sets, 1 for up to `large`, 2 for more, 3 for more than a block."""
    # The first shingle that two similar sets share lies, in the smaller one, within the short part of its prefix.
    short = F.col("pos") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-6)
    rows = prefixes.select("key", "n", F.posexplode("prefix").alias("pos", "hash")).select("key", "n", "hash", short.alias("short"))
    # One shuffle of the prefixes tells which shingles are shared, and keeps these.
    own = Window.partitionBy("hash")
    shared = rows.withColumn("sets", F.count("*").over(own)).withColumn("any", F.max("short").over(own)).filter("sets > 1 and any")
    crowded = F.when(F.col("sets") > max(block, large), 3).when(F.col("sets") > large, 2).when(F.col("sets") > small, 1).otherwise(0)
    return written(shared.select("key", "n", "hash", "short", crowded.alias("crowded")), "shared-shingles", "crowded")


def groups(docs: DataFrame, entries: DataFrame, everything: DataFrame, signatures: DataFrame, repeated: bool, similarity: float = SIMILARITY, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """key and comp (the least key of all that links reach) of the keys of entries (key, fp, row_key, doc_id) that have a candidate at all; the others are groups of their own.

    everything: as `shared_shingles`; signatures: key, n and wide of all rows, written, which is deleted once it has been read.
    """
    few, rows, most = (everything.filter(c) for c in ("crowded = 0", "crowded > 0", "crowded > 1"))

    # What the trie walk joins: fingerprints within the radius, and sets that have one fingerprint.
    first = written(entries.groupBy("fp").agg(F.min("key").alias("first"), F.max("key").alias("last")), "near-fingerprints")
    near = fingerprint_links(first.select("fp"), radius, MAX_NODE)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(k)) for c, k in (("u", "a"), ("v", "b")))
    same = entries.select("fp", "key").join(first.filter("first <> last"), "fp").filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    close = written(near.join(a, "u").join(b, "v").select("a", "b").unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-fingerprint-pairs")

    own = everything.select("key").unionByName(close.select(F.col("a").alias("key"))).unionByName(close.select(F.col("b").alias("key"))).distinct()
    known = signatures.select("key", "n", "wide").join(own, "key").groupBy("key").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    known = written(known, "near-known")
    discarded(signatures)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole sets are similar enough."""
        pairs = written(pairs, "near-candidates")
        if pairs.isEmpty():
            return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        # Written, so that Spark knows its size before it decides whether texts must be shuffled.
        keys = written(entries.select("key", "row_key", "doc_id").join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key"), "near-keys")
        sets = written(_sets(texts_of(docs, keys, repeated)), "near-sets")
        a, b = (sets.select(F.col("key").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
        return both.filter(F.col("common") >= similarity * (F.size("ha") + F.size("hb") - F.col("common")) - 1e-6).select(F.col("a").alias("u"), F.col("b").alias("v"))

    # The first round also takes what the trie walk found. Rounds end when one links few of the entries that it looked at.
    comp = known.select("key", F.col("key").alias("comp"))
    few_links = most.select("key").distinct().count() / 100
    for r in range(ROUNDS):
        # Each entry with one of each very crowded shingle that is not all in one group, another one each round; of these pairs the closest of each entry.
        now = most.select("key", "n", "hash").join(comp, "key")
        heads = now.groupBy("hash").agg(F.min_by(F.struct("key", "n", "comp"), F.xxhash64("key", F.lit(r))).alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        sized = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n") - 1e-6
        pairs = now.join(heads, "hash").filter((F.col("comp") != F.col("head.comp")) & sized).select(F.col("key").alias("a"), F.col("head.key").alias("b")).distinct()
        pairs = pairs if r else pairs.unionByName(close)
        new = written(verified(_possible(pairs, known, similarity).groupBy("a").agg(F.min_by("b", "apart").alias("b"))), "near-links")
        n = new.count()
        if n:
            comp = _grouped(comp, new)
        if n <= few_links:
            break

    # The sets of a shingle that few have: pairs whose sizes allow the similarity, of which the smaller has the shingle early.
    x, y = (few.join(comp, "key").select("hash", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "comp", "short")]) for side in "ab")
    early = (F.col("short_a") & (F.col("n_a") <= F.col("n_b"))) | (F.col("short_b") & (F.col("n_b") <= F.col("n_a")))
    sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    pairs = x.join(y, (x["hash"] == y["hash"]) & (F.col("key_a") < F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & sized & early)
    pairs = pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))

    # Of a crowded shingle: up to a block of sets meet as they are. Of more, those whose sizes allow the similarity lie in one band or in bands next to each other: each is at home in its own and a guest in the next.
    now = rows.select("key", "n", "hash", "crowded").join(comp, "key")
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / (-math.log(similarity) * (1 + 1e-9)))
    place = lambda b, home: F.struct(b.cast("long").alias("band"), F.lit(home).cast("long").alias("home"))
    now = now.withColumn("at", F.explode(F.when(F.col("crowded") == 3, F.array(place(band, 1), place(band + 1, 0))).otherwise(F.array(place(F.lit(-1), 1))))).select("hash", "key", "comp", "n", "at.*")
    sizes = now.groupBy("hash", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("any"), F.count("*").alias("size")).filter("lo <> hi and any = 1")
    now = now.join(sizes.select("hash", "band", F.ceil(F.col("size") / block).cast("long").alias("k")), ["hash", "band"]).withColumn("own", F.expr("pmod(xxhash64(key), k)"))
    # Cells that are the same but for a power of two fold into one: 1024 for all sets.
    folded = F.expr(f"transform(sequence(0, {CELLS // 64 - 1}), i -> aggregate(sequence(0, cast(size(wide) / {CELLS // 64} as int) - 1), 0L, (acc, j) -> acc ^ wide[j * {CELLS // 64} + i]))")
    now = now.join(known.select("key", folded.alias("sig")), "key").withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
    now = now.select("hash", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("long").alias("side"), "key", "n", "comp", "home", "sig")
    dealt = now.repartition("hash", "band", "x", "y").sortWithinPartitions("hash", "band", "x", "y", "side", "key")
    pairs = pairs.unionByName(dealt.mapInArrow(_block_pairs(similarity), "a long, b long")).distinct()
    last = written(verified(_possible(pairs, known, similarity).select("a", "b")), "near-links")
    return comp if last.isEmpty() else _grouped(comp, last)


def _grouped(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (key, comp) after links (u, v) between keys: only the groups that a link joins go through the rounds."""
    u, v = (comp.select(F.col("key").alias(c), F.col("comp").alias(f"{c}_comp")) for c in "uv")
    joined = links.join(u, "u").join(v, "v").select(F.col("u_comp").alias("u"), F.col("v_comp").alias("v"))
    roots = components(joined)
    return written(comp.join(roots, comp["comp"] == roots["node"], "left").select("key", F.coalesce("root", "comp").alias("comp")), "near-groups")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, crowd: int = CROWD, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """doc_id, row_key, kept_id and kept_key (the row that stays of its group) for every row of docs."""
    table = written(sketched(docs, similarity), "sketches")
    members = written(table.select("doc_id", "row_key", "key"), "near-members")
    signatures = written(table.select("key", "n", "wide"), "near-signatures")
    repeated = not members.groupBy("doc_id", "row_key").count().filter("count > 1").isEmpty()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    whole = table.groupBy("key").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    whole = written(whole.select("key", "n", "fp", "prefix", "first.*"), "near-prefixes")
    discarded(table)
    entries = written(whole.drop("prefix"), "near-entries")
    prefixes, made = settled(docs, whole, repeated, similarity, crowd)
    everything = shared_shingles(prefixes, similarity, small, large, block)
    discarded(whole, *made)
    comp = groups(docs, entries, everything, signatures, repeated, similarity, block)
    rooted = checkpointed(entries.join(comp, "key", "left").select("key", F.struct("no_id", "doc_id", "row_key").alias("first"), F.coalesce("comp", "key").alias("comp")))
    least = rooted.groupBy("comp").agg(F.min("first").alias("least"))
    of = rooted.join(least, "comp").select("key", "least")
    return members.join(of, "key").select("doc_id", "row_key", F.col("least.doc_id").alias("kept_id"), F.col("least.row_key").alias("kept_key"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id (of several such rows, that of the least row_key)."""
    return without_copies(docs, near_copies(docs, similarity))
