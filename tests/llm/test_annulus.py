import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import DATA, same_rows
from loomline.llm import annulus


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 3), st.integers(0, 10_000))
def test_annulus_finds_the_nearest_with_ties(k, n, width, seed):
    # Few different components: distances tie, and centroids lie on the edge of the annulus.
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-width, width + 1, (k, 3)), rng.integers(-width, width + 1, (n, 3))
    for was in (np.full(n, -1), rng.integers(-1, k, n)):
        cluster, distance = annulus.nearest(x, c, was)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()


def lloyd(rows, k, rounds, scale):
    """By force: (id, vector) of whole vectors."""
    q = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows]
    start = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[0] or 0, r[1]))[:k]
    c = [list(v) for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in q]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(q, of) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i is None, i or 0, *near(v)[::-1]) for i, v in q)), c


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(3, rows[3][1]), (4, [0.0] * 4), (None, [9.0] * 4), (200, rows[7][1])]
    left_out = [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + left_out, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "vector", "cluster", "distance", "sums")}).repartition(3)
    for k in (5, 200):
        state, at = annulus.clustered(df, k, 3, 4)
        want, c = lloyd(rows, k, 3, 64)
        assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in state.collect()) == want
        assert at.tolist() == c


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    state, at = annulus.clustered(none)
    assert state.count() == 0 and len(at) == 0
    with pytest.raises(Exception, match="in size"):
        annulus.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_query_equals_sql(spark, oracle):
    same_rows(annulus.op11_annulus(spark, DATA), oracle, annulus.ORACLE["op11_annulus"])
