import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks import DATA, same_rows
from loomline.llm import importance


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=12), st.integers(1, 5))
def test_ring_equals_checksums_of_joined_runs(words, longest):
    want = sorted(zlib.crc32(b" ".join(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    assert sorted(importance.crc_ring(words, longest)) == want


def by_force(rows, target, longest, buckets, least, percent):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    own, aim = [(i, words(t)) for i, t in rows], [b for t in target for b in feats(words(t))]
    s, t = {}, {}
    for into, of in ((s, [b for _, w in own for b in feats(w)]), (t, aim)):
        for b in of:
            into[b] = into.get(b, 0) + 1
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (total_s + buckets) / ((s.get(b, 0) + 1) * (total_t + buckets))))
    out = []
    for i, w in own:
        weight = sum(map(gain, feats(w)))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(feats(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(-1 if x is None else x for x in r[:5]) for r in out))


TARGET = ["Same TEXT here", None, "word1 and word2 and", "naïve 日本語"]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, make, edge_rows, longest):
    rows = edge_rows + [(20 + i, "same text " * (i % 5) + f"word{i} and more " * (i % 4)) for i in range(40)]
    target = make([(i, t) for i, t in enumerate(TARGET)])
    got = importance.resampled(make(rows).repartition(3), target, longest, 50, 4, 40)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == by_force(rows, TARGET, longest, 50, 4, 40)


def test_many_buckets_and_empty_tables(spark, make):
    docs, none = make([(1, "a b c d"), (2, "a")]), make([(1, "x")]).filter("doc_id > 1")
    assert importance.resampled(none, docs).count() == 0
    got = importance.resampled(docs, none, 2, 100_000, 1, 100)
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == by_force([(1, "a b c d"), (2, "a")], [], 2, 100_000, 1, 100)


def test_query_equals_sql(spark, oracle):
    same_rows(importance.op13_importance(spark, DATA), oracle, importance.ORACLE["op13_importance"])
