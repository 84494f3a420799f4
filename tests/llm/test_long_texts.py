"""Many matches in one text: time grows with them, and results are those of brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.llm import pii, secrets


def test_running_sums(spark):
    for n in (1, 2, 127, 128, 129, 1000, 5001):
        df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> i % 7)").alias("x"))
        got = df.select(F.expr(secrets._sums("x")).alias("s")).first().s
        assert got == [sum(i % 7 for i in range(1, k)) for k in range(1, n + 1)]


def test_free_candidates_by_force(spark, make):
    rng = random.Random(2)
    letters = "abcdefgh0123456789ABCDEFGH+/-_"
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice([lambda: "password: " + "".join(rng.choices(letters, k=rng.randint(3, 40))), lambda: "AKIA" + "".join(rng.choices("ABCDEF012", k=rng.randint(10, 24))), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 50))), lambda: "".join(rng.choices(letters, k=rng.randint(10, 40))), lambda: "word"])())
        texts.append(rng.choice(["", " ", "-"]).join(parts))
    s = secrets.scanned(make(list(enumerate(texts)))).cache()
    want = set()
    for r in s.collect():
        want |= {(r.doc_id, c.start, c.end, c.token) for c in r.candidates if not any(b.start < c.end and c.start < b.end for b in r.base)}
        assert all(texts[r.doc_id][c.start : c.end] == c.token for c in r.candidates)
    assert {(r.doc_id, r.start, r.end, r.token) for r in secrets.free_candidates(s).collect()} == want and len(want) > 20
    s.unpersist()


@pytest.mark.parametrize("n", [60_000])
def test_a_text_of_many_secrets(spark, make, n):
    line = "api_key = Zk3x9QpL7 and Qm4Xv8Lw2Zr7Np5Ys9Kd3Fh6 here\n"
    began = time.perf_counter()
    r = secrets.find_secrets(make([(1, line * n)])).select("n_assign", F.size("base").alias("base"), F.expr("base[size(base) - 1].start").alias("last"), F.size("spans").alias("spans")).first()
    assert (r.n_assign, r.base, r["last"]) == (n, n, len(line) * (n - 1)) and r.spans >= n
    assert time.perf_counter() - began < 60  # with the square of the matches it took minutes


def test_a_text_of_many_addresses():
    text = " ".join(f"write to user{i}@mail.example.org or call +49 30 {1000000 + i} now" for i in range(30_000))
    yes = lambda _: True
    began = time.perf_counter()
    found = list(pii._candidates(text, yes, yes))
    assert time.perf_counter() - began < 60 and len(found) > 100_000
    base = pii.base_spans(text)
    some = found[:: len(found) // 50]
    assert all(not any(a < e and s < b for a, _, b in base) for s, e, *_ in some)
