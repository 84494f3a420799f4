"""Personal data: base patterns, and contextual extraction that bootstraps from them.

What the base patterns find are seed entities. The words around each mention are
lexical patterns (two or three words before it, or one before and one after).
Patterns around enough different seeds of a kind are looked up in all texts: any
word there that no base pattern takes is a candidate, with digits or without, and
so is a short run of words with digits. Patterns and the instances they surround
form a graph, which Spark scores in rounds: a pattern's confidence for a kind is
the share of its instances that are of that kind, by their own scores, and an
instance's score for a kind is that of a noisy-or over its patterns. Seeds stay at
1. Candidates of a high score under a pattern of high confidence are accepted if
such patterns surround FOCUS of all their mentions: a common word that stands in
an identifier's place now and then is none. Wherever accepted ones stand in the
corpus induces patterns anew, together with the seeds, until a round accepts
nothing. Accepted mentions under patterns of high confidence
are reported as spans of their kind.

What a pass over the texts must know of patterns or values are up to EXACT of them,
or else a bitmap of their hashes of fixed size; what it emits is then joined exactly. Before candidates are
taken, a pass counts what each pattern surrounds, pre-aggregated in its tasks, and
patterns whose known mentions are under SHARE of all are out: "of the" costs a
count and no row a place. Edges are distinct and sums pre-aggregated before each
shuffle, so a context or a value that a third of all mentions share is one row a
task.

Defined results: null text is empty; a mention at the start of a text has the
context "^", at its end "$"; words of punctuation alone are skipped in contexts;
repeated rows repeat, each with its own spans, but an instance counts once for a
pattern; a null doc_id is kept; columns of docs may have any names; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_key, texts, written
from .words import Known

KINDS = ("email", "ip", "card", "phone")
#: Rounds of discovery and of scores within each; what a score and a confidence must reach; different instances and share of known mentions that a pattern needs.
ROUNDS, SCORES, CONFIDENCE, SUPPORT, SHARE = 4, 4, 0.8, 3, 0.1
#: Share of an instance's mentions that patterns of high confidence surround.
FOCUS = 0.5
#: Words to a candidate with digits; values that tasks are told themselves, and bits of the bitmap beyond.
LONGEST_RUN, EXACT, BITS = 4, 100_000, 1 << 22

# The base patterns. An IP address may only begin where a run of digits does: within one it fails as at its begin.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>*|%$#&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ backwards: time grows with the text and not with a word's square."""
    free = 0
    at = text.find("@")
    while at >= 0:
        if at >= free and (m := _DOMAIN.match(text, at)):
            start = at
            while start > free and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end of each word without the punctuation at its ends."""
    out = []
    for m in _WORD.finditer(text):
        if core := m[0].strip(_EDGE):
            start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
            out.append((start, start + len(core)))
    return out


def _words(text: str) -> list[str]:
    """The words of `_places` in lower case."""
    return [c for w in text.lower().split() if (c := w.strip(_EDGE))]


def _patterns(b0: str, b1: str, b2: str, after: str) -> list[str]:
    return [f"{b1} {b2} |", f"{b0} {b1} {b2} |", f"{b2} | {after}"]


def mentions(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and a record for each of them: kind, value and the patterns around it."""
    base, out = base_spans(text), []
    if base:
        places = _places(text)
        starts, ends = [s for s, _ in places], [e for _, e in places]
        for s, k, e in base:
            # Whole words before and after; what a span leaves of a word at its ends is a word too.
            i, j = bisect_left(starts, s), bisect_left(ends, e)
            before = [text[a : min(b, s)].strip(_EDGE).lower() for a, b in places[max(0, i - 4) : i]]
            after = [text[max(a, e) : b].strip(_EDGE).lower() for a, b in places[j : j + 2]]
            before, after = ["^", "^", "^", *filter(None, before)][-3:], [*filter(None, after), "$"][0]
            out.append({"kind": k, "value": text[s:e].lower(), "patterns": sorted(set(_patterns(*before, after)))})
    return base, out


_ROWS = "doc_id long, row_key long, base array<struct<start:int,kind:int,end:int>>, found array<struct<kind:int,value:string,patterns:array<string>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base (spans in order) and found (the same with their contexts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        mention = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            rows = [mentions(t.as_py() or "") for t in batch.column(2)]
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array([m for _, m in rows], mention)], names=["doc_id", "row_key", "base", "found"])

    return texts(_keyed(docs)).mapInArrow(run, _ROWS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each value's hash: of fixed size, and sure of what it lacks."""
    at = df.select(F.xxhash64(column).bitwiseAND(F.lit(BITS - 1)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, np.int64)
    for r in words:
        out[r.word] = r.bits
    return out.view(np.uint64)


def _held(df: DataFrame, column: str) -> frozenset | np.ndarray:
    """What tasks must know of a column's values: up to EXACT of them these themselves, else the bitmap of all. Either way what it lets through is joined exactly."""
    values = [r[0] for r in df.select(column).distinct().limit(EXACT + 1).collect()]
    return frozenset(values) if len(values) <= EXACT else _bitmap(df, column)


def _test(held: frozenset | np.ndarray) -> Callable[[str], bool]:
    """Whether a text is, or may be, among what is held."""
    if isinstance(held, frozenset):
        return held.__contains__
    bitmap = held
    import xxhash

    def learn(value: str) -> bool:
        h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42) & (BITS - 1)
        return bool(int(bitmap[h >> 6]) >> (h & 63) & 1)

    return Known(learn).__getitem__


def _candidates(text: str, last: Callable[[str], bool], wanted: Callable[[str], bool], placed: bool = True) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, value and pattern of each candidate under a wanted pattern. last: words that wanted patterns have before the gap. Not placed: only the pattern is right."""
    w = _words(text)
    n = len(w)
    digits = places = taken = None
    firsts, reach = [], []
    before = ["^", "^", "^", *w]
    for i in [i for i, b2 in enumerate(before[2 : n + 2]) if last(b2)]:
        b2 = before[i + 2]
        two = wanted(f"{before[i + 1]} {b2} |")
        word = w[i]
        j = i
        if _DIGIT.search(word):
            digits = digits or [bool(_DIGIT.search(x)) for x in w]
            if i and digits[i - 1]:
                continue  # within a run
            while j + 1 < n and j + 1 - i < LONGEST_RUN and digits[j + 1]:
                j += 1
        around = wanted(f"{b2} | {w[j + 1] if j + 1 < n else '$'}")
        if not two and not around:
            continue
        if taken is None:
            taken = base_spans(text)
            firsts, reach = [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))
        s, e, value = 0, 0, ""
        if placed or taken:
            places = places or _places(text)
            s, e, value = places[i][0], places[j][1], " ".join(w[i : j + 1])
            k = bisect_left(firsts, e)  # spans that begin before the candidate ends; one of them reaches into it
            if k and reach[k - 1] > s:
                continue
        for p in _patterns(before[i], before[i + 1], b2, w[j + 1] if j + 1 < n else "$"):
            if wanted(p):
                yield s, e, value, p


def _last_words(patterns: DataFrame) -> DataFrame:
    """The word before the gap of each pattern."""
    return patterns.select(F.regexp_extract("pattern", r"(\S+) \|( \S+)?$", 1).alias("word")).distinct()


def surrounded(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and n: how many candidates each of the patterns (column pattern) surrounds in docs."""
    last, wanted = _held(_last_words(patterns), "word"), _held(patterns, "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _test(last), _test(wanted)
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(2):
                n.update(p for *_, p in _candidates(t.as_py() or "", a, b, placed=False))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["pattern", "n"])

    counts = texts(_keyed(docs)).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return counts.join(patterns, "pattern", "left_semi")


def candidates(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, row_key, start, end, value and pattern of each candidate that one of the patterns surrounds."""
    last, wanted = _held(_last_words(patterns), "word"), _held(patterns, "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _test(last), _test(wanted)
        for batch in batches:
            rows = [(i, *c) for i, t in enumerate(batch.column(2)) for c in _candidates(t.as_py() or "", a, b)]
            at = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc_id", "row_key", "start", "end", "value", "pattern"])

    found = texts(_keyed(docs)).mapInArrow(run, "doc_id long, row_key long, start int, end int, value string, pattern string")
    return found.join(patterns, "pattern", "left_semi").select("doc_id", "row_key", "start", "end", "value", "pattern")


def contexts(docs: DataFrame, values: DataFrame) -> DataFrame:
    """value, kind, pattern and n: how often the values (with their kind) stand in which contexts."""
    wanted = _held(values, "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _test(wanted)
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(2):
                w = _words(t.as_py() or "")
                before = ["^", "^", "^", *w]
                for i in range(len(w)):
                    value = w[i]
                    for j in range(i, min(len(w), i + LONGEST_RUN)):
                        if j > i:
                            if not _DIGIT.search(w[j]):
                                break
                            value += " " + w[j]
                        if known(value):
                            n.update((value, p) for p in set(_patterns(before[i], before[i + 1], before[i + 2], w[j + 1] if j + 1 < len(w) else "$")))
                        if not _DIGIT.search(value):
                            break
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in n], pa.string()), pa.array([p for _, p in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["value", "pattern", "n"])

    found = texts(_keyed(docs)).mapInArrow(run, "value string, pattern string, n long")
    return found.join(values, "value").groupBy("value", "kind", "pattern").agg(F.sum("n").alias("n"))


def graph_scores(known: DataFrame, free: DataFrame, rounds: int = SCORES) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns (pattern, kind, confidence) and scores of candidates (value, kind, score).

    known: value, kind, pattern of known instances; free: value, pattern of candidates; both distinct.
    """
    sure = known.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    every = known.select("value", "pattern").unionByName(free).distinct().groupBy("pattern").agg(F.count("*").alias("all"))
    sure = checkpointed(sure.join(every, "pattern"))
    scores = None
    for _ in range(rounds):
        own = sure.withColumn("extra", F.lit(0.0))
        if scores is not None:  # candidates count for a pattern by their own scores
            extra = free.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("extra"))
            own = sure.join(extra, ["pattern", "kind"], "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
        patterns = own.withColumn("confidence", (F.col("seeds") + F.col("extra")) / (F.col("all") + 1)).select("pattern", "kind", "confidence")
        scores = checkpointed(free.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
    return checkpointed(patterns), scores


def focused(told: DataFrame, best: DataFrame, share: float = FOCUS) -> DataFrame:
    """value and kind of the instances of told (value, kind, pattern, n) of whose mentions at least that share lies in patterns of best (pattern, kind). Each mention has one pattern of each form; the form that best knows most of counts."""
    form = F.when(F.col("pattern").rlike(r"^\S+ \S+ \|$"), 1).when(F.col("pattern").rlike(r"\|$"), 2).otherwise(3)
    known = told.join(best.select("pattern", "kind", F.lit(True).alias("sure")).distinct(), ["pattern", "kind"], "left")
    forms = known.groupBy("value", "kind", form.alias("form")).agg(F.sum("n").alias("mentions"), F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("inside"))
    return forms.groupBy("value", "kind").agg(F.max("mentions").alias("mentions"), F.max("inside").alias("inside")).filter(F.col("inside") >= share * F.col("mentions")).select("value", "kind")


def bootstrap(docs: DataFrame, rows: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Mentions that patterns of high confidence surround: doc_id, row_key, start, end, kind."""
    m = rows.select(F.explode("found").alias("f")).select("f.*")
    known = written(m.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("value", "kind", "pattern").agg(F.count("*").alias("n")), "pii-known")
    found = rows.select("doc_id", "row_key", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("kind")).limit(0)
    accepted = None
    for _ in range(rounds):
        # Patterns around enough different known instances of a kind, and of these the ones that surround little else.
        able = known.groupBy("pattern", "kind").agg(F.count("*").alias("values")).filter(F.col("values") >= support).select("pattern").distinct()
        able = written(known.join(able, "pattern").groupBy("pattern").agg(F.sum("n").alias("known")), "pii-patterns")
        if able.isEmpty():
            break
        others = surrounded(docs, able.select("pattern"))
        live = able.join(others, "pattern", "left").filter(F.col("known") >= SHARE * (F.col("known") + F.coalesce("n", F.lit(0)))).select("pattern")
        live = written(live, "pii-live-patterns")
        if live.isEmpty():
            break
        hits = written(candidates(docs, live), "pii-candidates")
        free = hits.select("value", "pattern").distinct()
        if accepted is not None:  # known by now
            free = free.join(accepted, "value", "left_anti")
        free = checkpointed(free)
        patterns, scores = graph_scores(known.join(live, "pattern").select("value", "kind", "pattern"), free)
        best = checkpointed(patterns.filter(F.col("confidence") >= confidence))
        named = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")).filter(F.col("score") >= confidence).select("value", "kind")
        new = written(free.join(best, "pattern").join(named, ["value", "kind"]).select("value", "kind").distinct(), "pii-named")
        if not new.isEmpty():
            told = written(contexts(docs, new), "pii-contexts")
            new = written(focused(told, best), "pii-accepted")
        if new.isEmpty() and accepted is None:
            break
        everyone = new if accepted is None else accepted.unionByName(new)
        here = hits.join(best, "pattern").join(everyone, ["value", "kind"]).select("doc_id", "row_key", "start", "end", "kind")
        found = found.unionByName(here)
        if new.isEmpty():
            break
        accepted = everyone
        known = written(known.unionByName(told.join(new, ["value", "kind"], "left_semi")).groupBy("value", "kind", "pattern").agg(F.sum("n").alias("n")), "pii-known")
    return found.distinct()


_ORDERED = "array_sort(concat(base, coalesce(more, array())))"


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """A row for each of docs: doc_id, row_key, base and spans (arrays of start, kind, end)."""
    rows = written(scanned(docs), "pii-mentions")
    found = bootstrap(docs, rows, rounds, confidence, support)
    more = found.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more")).select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), "more")
    out = rows.select("doc_id", "row_key", "base").join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_key") == F.col("m_key")), "left")
    return out.select("doc_id", "row_key", "base", F.expr(_ORDERED).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, by comma."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
