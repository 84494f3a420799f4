import math
import random
import re
from collections import Counter, defaultdict

import pytest

from checks import DATA
from loomline.llm import secrets

LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS = {"base64": UP + LOW + DIGITS + "+/", "base62": UP + LOW + DIGITS, "base52": UP + LOW, "base32": LOW + "234567", "hex": DIGITS + "abcdef"}


def ordinary(rng):
    """Identifiers, slugs, paths, long words and dates, as texts have them."""
    words = "get user by name order list update the service account value with number from state config page index handler create total report monthly price customer session manager".split()
    pick = [rng.choice(words) for _ in range(rng.randint(3, 7))]
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(w.title() for w in pick) + rng.choice(["", "2", "V2"])
    if kind == 1:
        return "-".join(pick) + f"-{rng.randint(1, 2024)}"
    if kind == 2:
        return "/".join(pick)
    if kind == 3:
        return "_".join(pick).upper()
    return "".join(pick)


def normal(z):
    return math.erfc(-z / math.sqrt(2)) / 2


def by_force(token):
    """encoding, z_chi2, z_runs, z_serial and the p-value, from their definitions; None for no candidate."""
    if not re.search("[A-Za-z]", token):
        return None
    name, alphabet, _ = next(e for e in secrets.ENCODINGS if re.search(e[2], token))
    token = token.rstrip("=")
    text = token if any(c in UP for c in alphabet) else token.lower()
    code, k, n = [alphabet.index(c) for c in text], len(alphabet), len(text)
    counts = Counter(code)
    chi2 = sum((counts[c] - n / k) ** 2 / (n / k) for c in range(k))
    cube = lambda x, df: ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    z_chi2 = cube(chi2, k - 1)
    high = [c >= k / 2 for c in code]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean_runs = 1 + 2 * a * b / n
    spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    z_runs = (runs - mean_runs) / math.sqrt(spread) if spread > 0 else math.sqrt(n)
    mean = sum(code) / n
    var = sum((c - mean) ** 2 for c in code)
    z_serial = math.sqrt(n) * sum((x - mean) * (y - mean) for x, y in zip(code, code[1:])) / var if var else math.sqrt(n)
    q = secrets.text_model(alphabet)
    mean_sq = n + n * (n - 1) * sum(x**2 for x in q)
    var_sq = 2 * n * (n - 1) * (sum(x**2 for x in q) + 2 * (n - 2) * sum(x**3 for x in q) - (2 * n - 3) * sum(x**2 for x in q) ** 2)
    mu, v = k / n * mean_sq - n, (k / n) ** 2 * var_sq
    df = 2 * mu * mu / v
    z_text = ((chi2 / mu) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p = normal(z_text) if z_chi2 <= secrets.RANDOM and abs(z_runs) <= secrets.RANDOM and abs(z_serial) <= secrets.RANDOM else 1.0
    return name, z_chi2, z_runs, z_serial, p


def admitted_by_force(scores, level):
    """Benjamini and Hochberg within each encoding and band, on p-values rounded up to the step."""
    strata, out = defaultdict(list), set()
    for i, (name, length, p) in scores.items():
        strata[name, min(length // secrets.BAND, 64)].append((10 ** (-math.floor(-math.log10(p) * secrets.STEPS + 1e-9) / secrets.STEPS), i))
    for items in strata.values():
        best = max((p for p, _ in items if p < 1 and p <= level * sum(q <= p for q, _ in items) / len(items)), default=None)
        out |= {i for p, i in items if best is not None and p <= best}
    return out


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(5)
    out = [ordinary(rng) for _ in range(400)] + ["aaaa1" * 8, "0123456789abcdef" * 3, "1" * 30, "A" * 16, "QUJD" * 10 + "=="]
    for name in sorted(SYMBOLS):
        out += ["".join(rng.choice(SYMBOLS[name]) for _ in range(n)) for n in (16, 20, 24, 32, 40, 64, 100) for _ in range(6)]
    return [t for t in out if len(t) >= 16]


def test_statistics_and_false_discovery_rule_by_force(spark, tokens):
    df = spark.createDataFrame(list(enumerate(tokens)), "i int, token string").selectExpr("*", "length(token) as length")
    scored = secrets.randomness(df)
    got = {r.i: r for r in scored.collect()}
    want = {i: w for i, t in enumerate(tokens) if (w := by_force(t))}
    assert got.keys() == want.keys()
    for i, (name, *numbers) in want.items():
        r = got[i]
        assert r.encoding == name and [r.z_chi2, r.z_runs, r.z_serial] == pytest.approx(numbers[:3], abs=1e-6), tokens[i]
        assert r.p == pytest.approx(numbers[3], rel=0.05, abs=2e-7)
    for level in (0.01, 0.05, 0.3):
        # From one p-value to the discoveries: Spark's own p, so that the last digits of the tail don't decide.
        mine = {r.i for r in secrets.discoveries(scored, level).collect()}
        assert mine == admitted_by_force({i: (r.encoding, len(tokens[i]), r.p) for i, r in got.items()}, level)


def test_planted_tokens_are_found_in_a_small_and_a_larger_corpus(spark, tokens):
    """Random tokens of 32 and more characters in ordinary documents (shorter ones: half and less pass the rule); hardly a document without one is reported, whatever the number of documents."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for copies in (1, 5):
        rng = random.Random(copies)
        rows = [(k * 1000 + i, t) for k in range(copies) for i, t in base] + [(500_000 + i, f"see {ordinary(rng)} and {ordinary(rng)} for more") for i in range(200 * copies)]
        planted = {}
        for name in ("base64", "base62", "base52"):
            for n in (32, 40, 64):
                for _ in range(7):
                    i = 900_000 + len(planted)
                    planted[i] = "".join(rng.choice(SYMBOLS[name]) for _ in range(n))
        rows += [(i, f"the key {t} was in a log") for i, t in planted.items()]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id for r in secrets.find_secrets(df).collect() if any(s.kind == 3 for s in r.spans)}
        recall, false = len(found & planted.keys()) / len(planted), len(found - planted.keys())
        assert recall >= 0.8 and false <= 0.05 * len(found)
