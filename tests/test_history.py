import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.operators import diff, sketches
from loomline.operators.purge import Purge
from loomline.plans.usage import calls


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_scripts_are_shortest_and_rebuild_both(before, after):
    s = diff.script(before, after)
    assert [x for op, x in s if op != "add"] == before and [x for op, x in s if op != "drop"] == after
    assert sum(op == "keep" for op, _ in s) == lcs(before, after)


def test_long_versions(spark):
    rng = random.Random(1)
    a = [f"line {rng.randrange(900)}" for _ in range(3000)]
    b = a[1500:] + [f"new {i}" for i in range(50)] + a[:1500]
    s = diff.script(a, b)
    assert [x for op, x in s if op != "add"] == a and [x for op, x in s if op != "drop"] == b and sum(op == "keep" for op, _ in s) >= 1500
    v = spark.createDataFrame([(1, 1, "a\nb\na"), (1, 2, "a\na\nb"), (1, 3, None), (1, 4, ""), (2, 1, "\n".join(a)), (2, 2, "\n".join(b))], "p long, version_number int, content string")
    got = {(r.p, r.version_number): (r.text, [x.op for x in r.script]) for r in diff.version_scripts(v, "p").withColumn("text", diff.rebuilt()).collect()}
    assert got[1, 2][0] == "a\na\nb" and sorted(got[1, 2][1]) == ["add", "drop", "keep", "keep"]  # a moved line
    assert got[1, 3] == ("", ["drop"] * 3) and got[1, 4] == ("", ["add"]) and got[2, 2][0] == "\n".join(b)


def test_sketches_merge_over_any_range(spark):
    c = calls(spark, "/root/testdata/sf0.01")
    days = sketches.by_day(c).cache()
    # Days that come in parts are the same days.
    parts = sketches.merged(sketches.by_day(c.filter("user_id % 2 = 0")).unionByName(sketches.by_day(c.filter("user_id % 2 = 1"))), "day")
    for first, last in (("1992-01-01", "2010-12-31"), ("1996-05-05", "1997-06-05"), ("1998-01-01", "1998-01-03")):
        own = c.filter(F.col("day").between(first, last)).select("latency", "user_id").toPandas()
        for source in (days, parts):
            r = sketches.over(source, first, last, quantiles=(0.5, 0.95, 0.999)).first()
            assert r.requests == len(own) and abs(r.users - own["user_id"].nunique()) <= 0.05 * own["user_id"].nunique() + 1
            for q, got in ((0.5, r.p50), (0.95, r.p95), (0.999, r.p99_9)):
                assert (own["latency"] < got).mean() - 0.015 <= q <= (own["latency"] <= got).mean() + 0.015
    none = sketches.over(days, "2050-01-01", "2050-01-02").first()
    assert (none.requests, none.tokens, none.users, none.p50) == (0, 0, 0, None)
    days.unpersist()


def test_exact_quantiles(spark):
    rows = [(1, x) for x in (5, 1, 4, 2, 3)] + [(2, 7), (3, None)] + [(4, x % 10) for x in range(1000)]
    got = {r.k: (r.p50, r.p95, r.p100) for r in sketches.exact_quantiles(spark.createDataFrame(rows, "k long, v long"), "k", "v", (0.5, 0.95, 1.0)).collect()}
    for k in (1, 2, 4):
        v = np.array([x for i, x in rows if i == k])
        assert got[k] == tuple(int(np.quantile(v, q, method="inverted_cdf")) for q in (0.5, 0.95, 1.0))
    assert set(got) == {1, 2, 4}


def test_purge_walks_links_and_keeps_usage(spark):
    at, old, new = "timestamp '2024-05-01'", "timestamp '2024-01-01'", "timestamp '2024-04-01'"
    df = lambda rows, schema: spark.createDataFrame([r[:-1] for r in rows], schema).withColumn("deleted_at", F.expr("case " + " ".join(f"when id = {r[0]} then {r[-1]}" for r in rows if r[-1]) + " end") if any(r[-1] for r in rows) else F.lit(None).cast("timestamp"))
    tables = {
        "tenants": df([(1, None), (2, None), (3, old)], "id long"),
        "users": df([(10, 1, None), (11, 1, old), (12, 2, new), (13, 2, old), (14, None, None)], "id long, tenant_id long"),
        # a thread of four, of which the first belongs to a purged user; one of another user answers another thread
        "messages": df([(100, 10, None, None), (101, None, 100, None), (102, None, 101, new), (103, 12, 102, None), (104, 12, None, None)], "id long, user_id long, parent_id long"),
        "usage": spark.createDataFrame([(1000, 10), (1001, 12)], "id long, user_id long"),
    }
    purge = Purge(tables, dict.fromkeys(tables, "id"), [("users", "tenant_id", "tenants"), ("messages", "user_id", "users"), ("messages", "parent_id", "messages"), ("usage", "user_id", "users")], {"usage"})
    after = purge.run({"tenants": F.col("id") == 1}, F.expr(at))
    when = {n: {r.id: r.deleted_at and f"{r.deleted_at:%Y-%m-%d}" for r in t.collect()} for n, t in after.items() if n != "usage"}
    assert when["tenants"] == {1: "2024-05-01", 2: None} and when["users"] == {10: "2024-05-01", 12: "2024-04-01", 14: None}
    assert when["messages"] == {100: "2024-05-01", 101: "2024-05-01", 102: "2024-04-01", 103: "2024-05-01", 104: None}
    assert after["usage"].count() == 2
    counts = {r.name: (r.before, r.live, r.after) for r in purge.counts(after).collect()}
    assert counts == {"tenants": (3, 1, 2), "users": (5, 1, 3), "messages": (5, 1, 5), "usage": (2, 2, 2)}
    with pytest.raises(ValueError, match="depend on each other"):
        Purge(tables, dict.fromkeys(tables, "id"), [("users", "x", "messages"), ("messages", "y", "users")], set())
