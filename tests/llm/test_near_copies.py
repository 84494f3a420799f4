import random

import numpy as np

from loomline.llm import near_copies


def test_near_copies_by_force(spark, make, edge_rows):
    import corpus_pipeline as P

    rng = random.Random(13)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 90, 300]))]
        for _ in range(12):
            words = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(9999)}"] * rng.randint(0, 2)
            rows.append((100 + len(rows), " ".join(words)))
    passage = " ".join(f"common{i}" for i in range(30))
    rows += [(1000 + i, passage + " " + " ".join(f"v{rng.randrange(9999)}" for _ in range(rng.randint(20, 60)))) for i in range(60)]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: rows[find(k)][0] for k, (i, _) in enumerate(rows)}
    assert 20 < len(set(want.values())) < len(rows) - 40
    for small, large in ((1, 1), (4, 9), (500, 500)):  # all shingles crowded, some, none
        got = {r.doc_id: r.kept_id for r in near_copies.near_copies(make(rows), block=7, crowd=8, small=small, large=large).collect()}
        assert got == want
    kept = P.near_dedup(spark, make(rows), "")
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    out = near_copies.drop_near_copies(make(edge_rows))
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 4, 6, 7, 8, None]))
    assert near_copies.drop_near_copies(make(rows).limit(0)).count() == 0


def test_signature_bounds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, 300)) for _ in range(2))
        bits = np.bitwise_count((near_copies._signature(a) ^ near_copies._signature(b)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(a, b))
