import math
import random
from collections import defaultdict

from loomline.llm import pii


def spans(df):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in df.collect()}


def test_identifiers_without_digits_and_in_several_words(make):
    rows = [(i, f"dear sir, write to user{i}@mail.example.org for help") for i in range(20)]
    rows += [(100, "dear sir, write to maria(at)example for help"), (101, "Dear sir, WRITE TO maria.lopez@localhost, for help")]
    rows += [(200 + i, f"you may phone us on +1 555 555 {1000 + i} until noon") for i in range(20)]
    rows += [(300, "you may phone us on 555 123 4567 until noon"), (301, "we sat on the 3 chairs until noon")]
    got = spans(pii.find_personal_data(make(rows)))
    assert got[100] == [(19, 0, 35)] and got[101] == [(19, 0, 40)] and got[300] == [(20, 3, 32)] and got[301] == []
    assert all(len(got[i]) == 1 for i in (*range(20), *range(200, 220)))


def test_patterns_grow_from_what_was_found(make):
    """Seed, a pattern, a new identifier, another pattern that only the new ones have, further identifiers."""
    names = ["anna", "berta", "carla", "dora", "emil"]
    rows = [(i, f"please write to u{i}@mail.example.org soon") for i in range(30)]
    rows += [(100 + i, f"please write to {n}-home soon") for i, n in enumerate(names)]
    rows += [(200 + i, f"her secret handle is {n}-home indeed") for i, n in enumerate(names)]
    rows += [(300, "her secret handle is frieda-home indeed"), (301, "his name is frieda and so on")]
    got = spans(pii.find_personal_data(make(rows)))
    assert all(len(got[i]) == 1 for i in range(100, 105))
    assert got[300] == [(21, 0, 32)] and got[301] == []
    assert spans(pii.find_personal_data(make(rows), rounds=1))[300] == []


def test_frequent_contexts_are_not_patterns(make):
    rng = random.Random(4)
    words = [f"w{k}" for k in "abcdefghij"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (f" of the u{i}@mail.example.org" if i < 6 else f" of the {rng.choice(words)}")) for i in range(200)]
    got = spans(pii.find_personal_data(make(rows)))
    assert sum(map(len, got.values())) == 6


def test_scores_by_force(spark):
    rng = random.Random(8)
    known = {(f"k{rng.randrange(12)}", p, rng.randrange(2)) for p in "abcdef" for _ in range(rng.randint(1, 6))}
    kind_of = {v: k for v, _, k in sorted(known)}
    known = {(v, kind_of[v], p) for v, p, _ in known}
    free = {(f"f{rng.randrange(20)}", p) for p in "abcdefg" for _ in range(rng.randint(1, 8))}
    patterns, scores = pii.graph_scores(spark.createDataFrame(sorted(known), "value string, kind int, pattern string"), spark.createDataFrame(sorted(free), "value string, pattern string"), rounds=3)
    of = defaultdict(set)
    for v, p in free | {(v, p) for v, _, p in known}:
        of[p].add(v)
    seeds = defaultdict(int)
    for _, k, p in known:
        seeds[p, k] += 1
    score: dict = {}
    for _ in range(3):
        confidence = {(p, k): (n + sum(score.get((v, k), 0) for v, q in free if q == p)) / (len(of[p]) + 1) for (p, k), n in seeds.items()}
        score = {}
        for v in {v for v, _ in free}:
            for k in (0, 1):
                mine = [confidence[p, k] for w, p in free if w == v and (p, k) in confidence]
                if mine:
                    score[v, k] = 1 - math.prod(1 - c for c in mine)
    assert {(r.pattern, r.kind): round(r.confidence, 9) for r in patterns.collect()} == {k: round(c, 9) for k, c in confidence.items()}
    assert {(r.value, r.kind): round(r.score, 9) for r in scores.collect()} == {k: round(c, 9) for k, c in score.items()}
