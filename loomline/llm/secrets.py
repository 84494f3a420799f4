"""Secret scans: base patterns, and random-looking tokens by a battery of randomness tests. DataFrame operations only.

Positions come from splitting a text at a pattern and adding lengths up. Besides
the base patterns, each run of 16 or more characters of the usual encodings with a
letter in it is a candidate. Its encoding is the smallest of hex, letters of one
case, base 32, base 36, letters of both cases, base 62 and base 64 that has all
its characters. Over that alphabet it takes three tests, as normal scores:
chi-squared for uniform use of the characters, runs above and below the
alphabet's middle, and serial correlation of neighbours.

A token is reported if it looks random and text wouldn't. Random: none of the
three tests rejects it beyond RANDOM deviations. Text wouldn't: its p-value is the
probability that ordinary text of the same encoding and length uses its alphabet
so evenly. That comes from a fixed model (LETTERS and the shares beside it), by
the exact mean and variance of the chi-squared statistic under the model's
character frequencies and Wilson and Hilferty's cube root. So a token has the same
p-value in any corpus; those that fail a randomness test have 1. Benjamini and
Hochberg's rule then keeps the expected share of false discoveries under LEVEL
within each encoding and band of lengths: short tokens say little and rarely pass.
Median p of random tokens of 20, 32, 40 and 64 characters: base 64 0.04, 0.004,
0.0006, 2e-6; base 62 0.04, 0.003, 0.0003, 1e-8; base 32 0.1, 0.02, 0.006, 8e-5.
The rule works on a histogram (encoding, band, step of p), a bounded table
whatever the corpus; p-values are rounded up to the step. One pass over the texts
does everything else, and no text is shuffled: of a text's candidates those that
overlap a base span are told by a window over both in order.

Defined results: null text is empty; candidates that overlap a base span add
nothing; digits alone are numbers and never candidates; letters of one case say
little, so that some 60 of them are needed; repeated rows repeat, each with the
same spans; a null doc_id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, written

#: Base patterns in the order in which kinds are listed (assign: group 2 of 6 characters and more).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Characters of an encoding in the order of their values, and the pattern of a token in it; the first that fits is taken.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$"),
    ("letters", _LOWER, "^([a-z]+|[A-Z]+)$"),
    ("base32", _LOWER + "234567", "^([A-Z2-7]+|[a-z2-7]+)=*$"),
    ("base36", _DIGITS + _LOWER, "^([0-9a-z]+|[0-9A-Z]+)$"),
    ("base52", _UPPER + _LOWER, "^[A-Za-z]+$"),
    ("base62", _DIGITS + _UPPER + _LOWER, "^[0-9A-Za-z]+$"),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/-_", "^[0-9A-Za-z+/_-]+=*$"),
)
#: The model of ordinary text: per cent of each letter from a to z (English prose), and the shares of capitals among letters, of digits and of other characters.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
CAPITALS, NUMBERS, OTHERS = 0.05, 0.1, 0.05
#: Characters to a band of lengths, steps of a factor ten of p, share of false discoveries, deviations that a randomness test allows.
BAND, STEPS, LEVEL, RANDOM = 8, 20, 0.05, 2.6


def text_model(alphabet: str) -> list[float]:
    """How often ordinary text uses each character of an alphabet."""
    cased = any(c in alphabet for c in _UPPER) and any(c in alphabet for c in _LOWER)
    share = []
    for c in alphabet:
        if c in _DIGITS:
            share.append(NUMBERS / 10)
        elif c.isalpha():
            of = CAPITALS if c.isupper() else 1 - CAPITALS
            share.append((1 - NUMBERS - OTHERS) * LETTERS[ord(c.lower()) - ord("a")] / sum(LETTERS) * (of if cased else 1))
        else:
            share.append(OTHERS / 4)
    return [x / sum(share) for x in share]


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPANS = "array<struct<start:int,end:int,kind:int,token:string>>"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """The matches of a pattern, what a group took of each, and the parts between them; null if there are none."""
    p = _lit(pattern)
    return F.expr(f"case when {text} rlike {p} then named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', regexp_extract_all({text}, {p}, {group}), 'parts', split({text}, {p}, -1)) end")


#: Matches to a block: sums run within a block and over the blocks' sums, so that work grows with the matches and not with their square.
_BLOCK = 128


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value: made once, and not again in every lambda of body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums(values: str) -> str:
    """SQL of the running sums of an array, from 0, in blocks."""
    running = "aggregate({x}, named_struct('at', cast(0 as int), 'out', cast(array() as array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    blocks = f"transform(sequence(0, cast((size(v) - 1) / {_BLOCK} as int)), b -> slice(v, b * {_BLOCK} + 1, {_BLOCK}))"
    firsts = running.format(x="transform(blocks, block -> aggregate(block, 0, (acc, n) -> acc + n))")
    sums = f"flatten(zip_with(blocks, firsts, (block, first) -> transform({running.format(x='block')}, n -> n + first)))"
    return _let("v", values, _let("blocks", blocks, _let("firsts", firsts, sums)))


def spans(z: str, kind: int) -> Column:
    """Array of (start, end, kind, token) in code points from a column of `matches`."""
    before = _sums("transform(sequence(1, size({z}.m)), i -> length({z}.parts[i - 1]) + length({z}.m[i - 1]))".format(z=z))
    return F.expr(f"""
    coalesce(zip_with({before}, sequence(0, size({z}.m) - 1), (at, i) -> named_struct(
      'start', at + length({z}.parts[i]), 'end', at + length({z}.parts[i]) + length({z}.m[i]), 'kind', {kind}, 'token', {z}.g[i])), cast(array() as {_SPANS}))""")


#: Spans of several kinds in one order, without their tokens.
_ORDERED = "transform(array_sort(transform({}, s -> struct(s.start, s.kind, s.end))), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, counts and spans (base, in order) of the base patterns, and candidates (spans for the tests, those that overlap base spans too)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "row_key", matches("text", ASSIGN, 2).alias("z0"), matches("text", ACCESS).alias("z1"), matches("text", HEX).alias("z2"), matches("text", CANDIDATE).alias("z3"))
    t = t.select("doc_id", "row_key", F.filter(spans("z0", 0), lambda s: F.length(s["token"]) >= 6).alias("assign"), spans("z1", 1).alias("access"), spans("z2", 2).alias("hex"), spans("z3", 3).alias("candidates"))
    return t.select("doc_id", "row_key", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")], F.expr(_ORDERED.format("concat(assign, access, hex)")).alias("base"), "candidates")


def free_candidates(s: DataFrame) -> DataFrame:
    """doc_id, row_key, start, end and token of the candidates of s (as `scanned`) that overlap no base span: a base span reaches into one from the left, or begins in it."""
    at = "transform({}, x -> named_struct('start', x.start, 'end', x.end, 'token', {}))"
    both = F.expr(f"concat({at.format('candidates', 'x.token')}, {at.format('base', 'cast(null as string)')})")
    rows = s.filter(F.size("candidates") > 0).select("doc_id", "row_key", F.explode(both).alias("x")).select("doc_id", "row_key", "x.*")
    # Both windows run from an end of the text to the row: one that ran on to the other end would begin anew at each row.
    base, w = F.col("token").isNull(), Window.partitionBy("doc_id", "row_key")
    rows = rows.withColumn("reach", F.max(F.when(base, F.col("end"))).over(w.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next", F.min(F.when(base, F.col("start"))).over(w.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)))
    taken = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return rows.filter(~base & ~taken).drop("reach", "next")


def _chosen(values: list, kind: str) -> Column:
    """The value of the encoding of `token`: that of the first whose pattern fits."""
    out = F.lit(None).cast(kind)
    for (_, _, pattern), value in reversed(list(zip(ENCODINGS, values))):
        out = F.when(F.col("token").rlike(pattern), F.lit(value).cast(kind)).otherwise(out)
    return out


def randomness(tokens: DataFrame) -> DataFrame:
    """tokens (column `token`) that have a letter, with encoding, z_chi2, z_runs, z_serial, z_text and p (of ordinary text, 1 if a test says not random)."""
    models = [text_model(alphabet) for _, alphabet, _ in ENCODINGS]
    t = tokens.filter(F.col("token").rlike("[A-Za-z]"))
    t = t.withColumn("encoding", _chosen([e[0] for e in ENCODINGS], "string")).filter(F.col("encoding").isNotNull())
    t = t.withColumn("alphabet", _chosen([e[1] for e in ENCODINGS], "string"))
    t = t.withColumn("s2", _chosen([sum(q**2 for q in m) for m in models], "double")).withColumn("s3", _chosen([sum(q**3 for q in m) for m in models], "double"))
    t = t.withColumn("folded", F.when(F.col("alphabet").rlike("[A-Z]"), F.col("token")).otherwise(F.lower("token")))
    t = t.withColumn("code", F.expr("transform(filter(split(folded, ''), c -> c <> '' and c <> '='), c -> cast(locate(c, alphabet) - 1 as double))"))
    t = t.withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.size("code").cast("double"))
    # Chi-squared by its cube root (Wilson and Hilferty); runs by Wald and Wolfowitz; correlation of neighbours times the root of n.
    t = t.withColumn("squares", F.expr("aggregate(array_distinct(code), 0D, (acc, x) -> acc + pow(size(filter(code, y -> y = x)), 2))"))
    t = t.withColumn("chi2", F.expr("squares * k / n - n"))
    cube = "(pow(greatest({x}, 0D), 1/3D) - (1 - 2 / (9 * ({df})))) / sqrt(2 / (9 * ({df})))"
    t = t.withColumn("z_chi2", F.expr(cube.format(x="chi2 / (k - 1)", df="k - 1")))
    t = t.withColumn("high", F.expr("cast(size(filter(code, x -> x >= k / 2)) as double)")).withColumn("low", F.col("n") - F.col("high"))
    t = t.withColumn("runs", F.expr("1D + size(filter(sequence(1, size(code) - 1), i -> (code[i] >= k / 2) <> (code[i - 1] >= k / 2)))"))
    t = t.withColumn("expected", F.expr("1 + 2 * high * low / n")).withColumn("spread", F.expr("sqrt(greatest((expected - 1) * (expected - 2) / (n - 1), 0D))"))
    t = t.withColumn("z_runs", F.expr("case when spread > 0 then (runs - expected) / spread else sqrt(n) end"))
    t = t.withColumn("mean", F.expr("aggregate(code, 0D, (acc, x) -> acc + x) / n")).withColumn("var", F.expr("aggregate(code, 0D, (acc, x) -> acc + pow(x - mean, 2))"))
    t = t.withColumn("z_serial", F.expr("case when var > 0 then sqrt(n) * aggregate(sequence(1, size(code) - 1), 0D, (acc, i) -> acc + (code[i] - mean) * (code[i - 1] - mean)) / var else sqrt(n) end"))
    # Mean and variance of the sum of squared counts under the model of text, then of chi-squared, matched by a gamma distribution.
    t = t.withColumn("mu", F.expr("k * (1 + (n - 1) * s2) - n"))
    t = t.withColumn("df", F.expr("2 * mu * mu / (k * k / (n * n) * 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2))"))
    t = t.withColumn("z_text", F.expr(cube.format(x="chi2 / mu", df="df")))
    # The normal distribution's lower tail: five-term rational approximation, and the leading terms of the tail's series where that has no digits left.
    t = t.withColumn("u", F.expr("1 / (1 + 0.2316419 * abs(z_text))")).withColumn("density", F.expr("exp(-z_text * z_text / 2) / sqrt(2 * pi())"))
    near = "density * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))"
    tail = F.expr(f"case when z_text < -5 then density / -z_text * (1 - 1 / (z_text * z_text)) when z_text <= 0 then {near} else 1 - {near} end")
    p = F.when(F.expr(f"z_chi2 <= {RANDOM} and abs(z_runs) <= {RANDOM} and abs(z_serial) <= {RANDOM}"), F.least(F.lit(1.0), tail)).otherwise(1.0)
    return t.withColumn("p", p).drop("alphabet", "s2", "s3", "folded", "code", "k", "n", "squares", "chi2", "high", "low", "runs", "expected", "spread", "mean", "var", "mu", "df", "u", "density")


def discoveries(scored: DataFrame, level: float = LEVEL) -> DataFrame:
    """scored (columns encoding, length, p) without what the false-discovery rule of its encoding and band of length doesn't admit."""
    step = F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * STEPS + 1e-9).cast("int")
    s = scored.withColumn("band", F.least(F.floor(F.col("length") / BAND), F.lit(64)).cast("int")).withColumn("step", step)
    # A row for each encoding, band and step of p: at most 7 x 65 x 601, whatever the corpus.
    tally = s.groupBy("encoding", "band", "step").agg(F.count("*").alias("n"))
    every = Window.partitionBy("encoding", "band")
    tally = tally.select("encoding", "band", "step", F.sum("n").over(every.orderBy(F.desc("step"))).alias("found"), F.sum("n").over(every).alias("all"))
    admitted = (F.col("step") > 0) & (F.pow(F.lit(10.0), -F.col("step") / STEPS) <= level * F.col("found") / F.col("all"))
    least = tally.filter(admitted).groupBy("encoding", "band").agg(F.min("step").alias("least"))
    return s.join(least, ["encoding", "band"]).filter(F.col("step") >= F.col("least")).drop("band", "step", "least")


def find_secrets(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """A row for each of docs: doc_id, row_key, counts of base kinds, base and all spans as arrays of (start, end, kind)."""
    s = written(scanned(docs), "secret-spans")
    tokens = free_candidates(s).withColumn("length", F.length("token"))
    found = discoveries(written(randomness(tokens).select("doc_id", "row_key", "start", "end", "encoding", "length", "p"), "randomness"), level)
    more = found.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end", F.lit(3).alias("kind"))).alias("more")).select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "more")
    out = s.join(more, s.doc_id.eqNullSafe(more.m_id) & (s.row_key == more.m_key), "left")
    every = F.expr(_ORDERED.format("concat(base, coalesce(more, array()))"))
    return out.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "base", every.alias("spans"))


def joined(spans_column: str) -> Column:
    """kind:start:end of each span, by comma."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans_column}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
