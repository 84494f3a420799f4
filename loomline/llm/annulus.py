"""Centroid clustering: rounds of nearest-centroid assignment by annulus search, in whole numbers.

A centroid at distance r of a vector has a norm within r of the vector's norm. So
centroids are sorted by norm, and a vector meets only those whose norms lie in the
annulus that its upper bound allows: the distance to the centroid it was nearest to
in the round before, as it stands now (in the first round, to the one nearest in
norm). Both ends of the annulus are found by binary search and lie a little
outside it, so that rounding loses no centroid on the boundary; the candidates are
compared by exact squared distances, ties to the smaller number.

Vectors are turned into integers once and written; each round reads the table of
the one before, writes vectors with their centroid, and sums them in Spark: of a
round only centroids x components sums reach the driver, whatever the input.

Defined results: vectors that are null, of another length, or with a component
that is null or not finite are left out; with fewer vectors than centroids, each
starts one; rows that repeat an id are vectors of their own, and start in the order
of their components; a null id starts last, after all others; an empty centroid
stays where it is; an empty table gives an empty result; a component over 2**26 in
size is an error, since squared distances must fit 64 bits; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 26
#: (vector, candidate) pairs compared at once.
_PAIRS = 20_000

_STATE = "vec_id long, vector array<int>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and vector (floor(scale * x) of each component x) of rows (vec_id, embedding) whose vectors are whole."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.filter((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("v"))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return out.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is over {LARGEST} in size"))).otherwise(F.col("v")).cast("array<int>").alias("vector"))


def nearest(x: np.ndarray, centroids: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x, and the squared distance to it. was: the centroid of the round before, or -1."""
    length = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
    order = np.lexsort((np.arange(len(centroids)), length))
    length, sorted_ = length[order], centroids[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    right = np.clip(np.searchsorted(length, norm), 1, max(len(order) - 1, 1)).clip(max=len(order) - 1)
    left = np.maximum(right - 1, 0)
    by_norm = np.where(norm - length[left] <= length[right] - norm, left, right)
    at = np.where(was >= 0, place[was], by_norm)
    reach = np.sqrt(((x - sorted_[at]) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9) + 1e-6
    lo, hi = np.searchsorted(length, norm - reach, "left"), np.searchsorted(length, norm + reach, "right")
    n = hi - lo  # at least the centroid that gave the bound
    ends = np.cumsum(n)
    cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    first = 0
    while first < len(x):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _PAIRS, "right")))
        k = n[first:last]
        starts = np.cumsum(k) - k
        row = np.repeat(np.arange(first, last), k)
        candidate = np.arange(len(row)) - np.repeat(starts - lo[first:last], k)
        d = ((x[row] - sorted_[candidate]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(d, starts)
        number = np.where(d == np.repeat(best, k), order[candidate], len(order))
        cluster[first:last], distance[first:last] = np.minimum.reduceat(number, starts), best
        first = last
    return cluster, distance


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """state (vec_id, vector, cluster, distance) with each vector's nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                was = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, distance = nearest(_matrix(batch.column(1), centroids.shape[1]), centroids, was)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "vector", "cluster", "distance"])

    return state.mapInArrow(run, _STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at floor(sum / count) of its vectors; one without vectors stays."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(total, cluster, _matrix(batch.column(0), dimensions))
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        sums = np.concatenate([total[some], count[some, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "sums"])

    sums = state.select("vector", "cluster").mapInArrow(run, "cluster long, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "n"))
    out = centroids.copy()
    found: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("cluster", "at").agg(F.sum("n").alias("n")).collect():  # centroids x components
        found.setdefault(r["cluster"], {})[r["at"]] = r["n"]
    for c, of in found.items():
        out[c] = [of[i] // of[dimensions] for i in range(dimensions)]
    return out


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, vector, cluster and distance (squared) of rows (vec_id, embedding), and the centroids after the last round."""
    rows = written(whole_vectors(vectors, dimensions, scale).select("*", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(drawn.asc_nulls_last(), "vec_id", "vector").select("vector").limit(centroids).collect()
    if not first:
        return rows, np.empty((0, dimensions), np.int64)
    at, state = np.array([r[0] for r in first], np.int64), rows
    for _ in range(rounds):
        state = written(assigned(state, at), "assigned")
        at = moved(state, at)
    return written(assigned(state, at), "assigned"), at


def op11_annulus(spark, sf_dir: str) -> DataFrame:
    state, at = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    of = {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a centroid
    known = [(c, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c in of]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """Centroids c{i} from c{i-1}: nearest by squared distance, then floors of means (rounded down also below zero)."""
    return f"""
a{i} as materialized (
  select vec_id, c, d from (
    select x.vec_id, c.c, sum((x.v - c.v) ** 2)::bigint as d from x join c{i - 1} c using (i) group by all
  ) qualify row_number() over (partition by vec_id order by d, c) = 1
), c{i} as materialized (
  select c.c, c.i, coalesce(m.v, c.v) as v from c{i - 1} c left join (
    select c, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v from a{i} join x using (vec_id) group by all
  ) m using (c, i)
)"""


ORACLE = {
    "op11_annulus": f"""
with q as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS}
), x as materialized (
  select vec_id, unnest(range(1, {DIMENSIONS + 1})) as i, unnest(v) as v from q
), s as (
  select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c from q qualify c < {CENTROIDS}
), c0 as materialized (
  select c::bigint as c, i, v from s join x using (vec_id)
), {",".join(_round(i) for i in range(1, ROUNDS + 2))}, f as (
  select c, sha256(string_agg(v::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by c
)
select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, centroid_sha256
from a{ROUNDS + 1} join f using (c)
"""
}
