"""Approximate nearest neighbours by cosine: an inverted file of cells, of which a search reads a few.

Centroids are learnt on the driver from a bounded sample (the SAMPLE vectors whose
keys have the least hashes, fewer if they are long); every vector is then put into
the cell of the centroid nearest to it. Cells are folders, so a search with a few
probes lists and reads the folders of those cells only, and a crowded cell is as
many files and tasks as it needs. Within the cells that are read the search is
exact; with as many probes as cells it is exact altogether.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, small_batches
from .vector import _HIT, BLOCK, NUMBERS, QUERIES, _best, _nearest, _units

#: Vectors to learn from at most, and numbers that these may hold (32 MB); cells at most; rounds of learning.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 12


def _learnt(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of length 1 by rounds of nearest-centroid means; a cell that loses all its vectors takes the vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        # In parts: all fits at once would be SAMPLE x CELLS numbers.
        fits = [(x.argmax(axis=1), x.max(axis=1)) for x in (sample[i : i + 4096] @ at.T for i in range(0, len(sample), 4096))]
        cell, best = (np.concatenate(x) for x in zip(*fits, strict=True))
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(length < 1e-12)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        at = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return at


def _least(rows: DataFrame, n: int, most: int) -> pd.Series:
    """v of the rows (n in all) whose ids have the least hashes. Each partition would send so many rows to the driver; so hashes that are too large for that are left out first, unless too few rows are left."""
    least = lambda x: x.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toPandas()["v"]
    share = 1.2 * most / max(n, 1)
    if share < 1:
        some = least(rows.filter(F.xxhash64("id") < int((share - 0.5) * 2**64)))
        if len(some) == most:
            return some
    return least(rows)


def probes(m: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n centroids nearest to each row of m."""
    return np.argsort(-(m @ at.T), axis=1, kind="stable")[:, : min(n, len(at))]


def _near(m: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Whether a centroid (column) is among the n nearest to a row of m."""
    out = np.zeros((len(m), len(at)), bool)
    for i in range(0, len(m), 256):
        np.put_along_axis(out[i : i + 256], probes(m[i : i + 256], at, n), True, axis=1)
    return out


def _groups(sizes: Iterable[int], most: int) -> list[int]:
    """A number for each cell: neighbours share one while they hold at most so many vectors; a larger cell has its own."""
    out, now, total = [], -1, 0
    for n in sizes:
        if now < 0 or total + n > most:
            now, total = now + 1, 0
        total += n
        out.append(now)
    return out


def _in_cells(rows: pd.DataFrame, ids: np.ndarray, m: np.ndarray, near: np.ndarray, k: int, threshold: float, exclude_self: bool, digits: int) -> pd.DataFrame:
    """The k best of the index's vectors (rows: id, v, cell) for each query (ids, m) within the cells that are near it."""
    rows = rows.sort_values("id", kind="stable")
    if len(rows) == 0 or len(ids) == 0:
        return _nearest({}, {}, k, threshold, exclude_self, digits)
    v = np.stack(rows["v"].to_numpy())
    return _nearest({v.shape[1]: (rows["id"].to_numpy(), v)}, {v.shape[1]: (ids, m)}, k, threshold, exclude_self, digits, near[:, rows["cell"].to_numpy()])


class CellIndex:
    """An index under a path: `vectors` in folders by cell, `centroids` with the size of each cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most CELLS
        self.at = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.vectors = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dim: int, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Indexes the vectors of `dim` numbers that have a length; the others match nothing (`vector.of_other_size` reports them). cells: the square root of their number unless given."""
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.size("v") == dim)
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("length", length).filter((F.col("length") > 0) & (F.col("length") < float("inf")))
        rows = rows.select("id", F.transform("v", lambda x: x / F.col("length")).alias("v"))
        n = rows.count()
        cells = max(1, min(cells or isqrt(n), CELLS, max(n, 1)))
        some = _least(rows, n, max(cells, min(sample, NUMBERS // dim)))
        at = _learnt(np.stack(some.to_numpy()), cells) if len(some) else np.zeros((0, dim))

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=(np.stack(pdf["v"].to_numpy()) @ at.T).argmax(axis=1).astype(np.int32))

        placed = saved(small_batches(rows).mapInPandas(put, "id long, v array<double>, cell int"), "cells")
        # Ranges of (cell, hash) cut a crowded cell into several files and leave the others in one.
        placed.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(f"{path}/vectors")
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        known = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(at)]
        vectors.sparkSession.createDataFrame(known, "cell int, centroid array<double>, n long").coalesce(1).write.parquet(f"{path}/centroids")
        return cls(vectors.sparkSession, path)

    def search(self, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, threshold: float = 0.5, exclude_self: bool = True, nprobe: int = 8, digits: int = 6) -> DataFrame:
        """query_id, vec_id, score and rank as `vector.top_k` has them, among the vectors of the nprobe cells nearest to each query."""
        q = queries.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(F.size("v") == self.at.shape[1])
        most = min(QUERIES, NUMBERS // max(1, self.at.shape[1]))
        few = q.limit(most + 1).toPandas()
        if len(self.at) == 0 or len(few) == 0:
            return self.spark.createDataFrame([], _HIT + ", rank int")
        return _best(self._of_few(few, k, threshold, exclude_self, nprobe, digits) if len(few) <= most else self._of_many(q, k, threshold, exclude_self, nprobe, digits), k)

    def _of_few(self, few: pd.DataFrame, k: int, threshold: float, exclude_self: bool, nprobe: int, digits: int) -> DataFrame:
        """The queries go to all tasks once, with a bit for each of their cells."""
        ids, m = _units(few).get(self.at.shape[1], (np.empty(0, np.int64), np.empty((0, self.at.shape[1]))))
        near = _near(m, self.at, nprobe)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            top = lambda x: x.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id").head(k)
            for pdf in batches:
                on = near[:, pdf["cell"].unique()].any(axis=1)
                best = pd.concat([best, _in_cells(pdf, ids[on], m[on], near[on], k, threshold, exclude_self, digits)])
                if len(best) > 4 * k * len(ids):
                    best = top(best)
            yield top(best)

        return small_batches(self.vectors).filter(F.col("cell").isin(np.flatnonzero(near.any(axis=0)).tolist())).mapInPandas(run, _HIT)

    def _of_many(self, q: DataFrame, k: int, threshold: float, exclude_self: bool, nprobe: int, digits: int) -> DataFrame:
        """Cells are put into groups of about BLOCK vectors. A query goes to the groups that hold cells of it, once to each; a group's vectors and its queries are dealt into blocks, and each pair of blocks is one task's product."""
        at = self.at  # the index itself holds a session and stays here
        filled, group = self.sizes > 0, np.array(_groups(self.sizes.tolist(), BLOCK))

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ids, m in _units(pdf).values():
                    near = _near(m, at, nprobe)
                    to = [np.unique(group[x & filled]).astype(np.int32) for x in near]
                    yield pd.DataFrame({"id": ids, "v": list(m), "near": [x.tobytes() for x in np.packbits(near, axis=1)], "to": to})

        asked = saved(small_batches(q).mapInPandas(probed, "id long, v array<double>, near binary, to array<int>"), "probes")
        asked = asked.select("id", "v", "near", F.explode("to").alias("group"))
        n_q = {r["group"]: r["count"] for r in asked.groupBy("group").count().collect()}  # a row a group
        n_v = np.bincount(group, self.sizes)
        cells = [(c, int(g), -(-int(n_v[g]) // BLOCK), -(-n_q[g] // BLOCK)) for c, g in enumerate(group.tolist()) if g in n_q]
        blocks = self.spark.createDataFrame(cells, "cell int, group int, n_v int, n_q int")
        deal = lambda rows, by, mine, other, *more: rows.join(F.broadcast(by), by.columns[0]).select("group", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"), "id", "v", *more)
        none = lambda kind: F.lit(None).cast(kind)
        v = deal(self.vectors, blocks, "n_v", "n_q", "cell", none("binary").alias("near")).withColumnsRenamed({"own": "vb", "other": "qb"})
        both = v.unionByName(deal(asked, blocks.drop("cell").distinct(), "n_q", "n_v", none("int").alias("cell"), "near").withColumnsRenamed({"own": "qb", "other": "vb"}))

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            on = pdf["near"].notna().to_numpy()
            of, rows = pdf[on], pdf[~on]
            if not on.any():
                return _in_cells(rows, np.empty(0, np.int64), None, None, k, threshold, exclude_self, digits)
            near = np.unpackbits(np.frombuffer(b"".join(of["near"]), np.uint8).reshape(len(of), -1), axis=1, count=len(at)).view(bool)
            return _in_cells(rows.astype({"cell": "int32"}), of["id"].to_numpy(), np.stack(of["v"].to_numpy()), near, k, threshold, exclude_self, digits)

        return both.groupBy("group", "vb", "qb").applyInPandas(best, _HIT)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """hits (of the exact search) and recall: how large a share of them was found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("hits"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall"))
