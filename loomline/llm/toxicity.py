"""Toxicity by weak supervision.

Voters are lexicons of insults, one a language, and word patterns (words and
prefixes) that fire when they occur often enough in a text. The lexicons vote from
the start, with or without labels. The patterns are induced twice: first from a
bounded sample of labelled learning rows; then a first label model names further
documents of a sample without labels as toxic or not, and the patterns are induced
again from both, so that most of them come from documents that nobody labelled.
Voters are taken one by one, each for what it says of toxic documents that those
before it leave silent; so rare languages get theirs.

The generative label model takes all learning documents, labelled or not: by
expectation maximisation it estimates how often each voter fires in either class
and how voters correlate within a class. A voter that fires votes toxic, one that
doesn't abstains. Those of a document's votes that repeat each other share one
voice, in each round by the correlations of the round before. A gold label, where
there is one, is a further voter. The model's posterior labels the samples for a
linear classifier (logistic regression with an L2 penalty) over the counts of all
induced features and the voters' votes.

Texts are read whole twice: the first passes look only into the samples, the last
reduces each text to its counts of induced features, a small table from
which votes, sums and scores come. The label model works on different sets of
votes and how many documents have each: up to FEW_MASKS of them on the driver,
more by sums in Spark.

Bounds (documented parameters): SAMPLE labelled rows and half as many without a
label, those of the smallest hashes of doc_id; FEATURES, and 16 times as many
candidates for them, by the difference of their frequencies in the classes;
VOTERS; the share of toxic documents in the model within 0.005 and 0.5. What is
broadcast or sent to the driver follows these and not the corpus.

Defined results: null and empty texts have no features and get the score of a
text without any; a doc_id labelled twice with different labels is not sampled;
null labels don't count; repeated documents repeat; without labels of both
classes only the lexicons vote, at assumed rates; columns of documents may have
any names; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, texts, written

SAMPLE, FEATURES, VOTERS, ROUNDS = 20_000, 512, 56, 12
THRESHOLD = 0.7
#: Different sets of votes (and gold labels) that the driver sums up itself: 3 numbers each.
FEW_MASKS = 20_000
#: A round of the label model that moves no rate by this much is the last.
SETTLED = 1e-3
#: What a gold label is taken to be right at, as a voter; the posterior at which a document without one counts as labelled for the second induction.
GOLD, SURE = 0.98, 0.95
#: Log-likelihood ratio below which a feature may be chance: some hundred thousand are looked at.
LEAST_G2 = 22.0
#: Share of toxic documents and rates of a lexicon's voter in either class (0, 1), assumed until the model knows better.
PRIOR, RATES = 0.1, (0.005, 0.3)
#: Insults by language (fixed values).
LEXICON = {
    "en": "clown disgusting dumb dumbass fool garbage idiot idiotic idiots imbecile jerk loser losers moron morons pathetic scum scumbag stupid trash worthless".split(),
    "de": "abschaum arschloch bastard blödmann depp dreckig dumm dummkopf idiot idioten nichtsnutz schwachkopf trottel versager widerlich wertlos".split(),
    "es": "asqueroso asquerosa basura cabrón estúpido estúpida escoria idiota imbécil inútil payaso patético pendejo perdedor tonto".split(),
    "fr": "abruti bouffon connard connasse crétin débile dégoûtant idiot idiote imbécile loser minable nul ordure pathétique pourriture raté stupide".split(),
}
_LISTS = {w: [f"{lang}!" for lang in LEXICON if w in LEXICON[lang]] for words in LEXICON.values() for w in words}
_WORD = re.compile(r"\w+")
_PREFIXES = range(4, 9)


def features(word: str) -> list[str]:
    """A word, the prefix patterns that it belongs to (ending with *) and the lexicons that list it (ending with !)."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) > n), *_LISTS.get(word, ())]


def _g2(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of occurrence and class; negative where occurrence speaks against toxicity."""
    a, b, c, d = (np.maximum(np.asarray(x, float), 0) + 0.5 for x in (pos, neg, n_pos - pos, n_neg - neg))
    n = a + b + c + d
    e = lambda r, s: r * s / n
    g = 2 * (a * np.log(a / e(a + b, a + c)) + b * np.log(b / e(a + b, b + d)) + c * np.log(c / e(c + d, a + c)) + d * np.log(d / e(c + d, b + d)))
    return np.where(a / (n_pos + 1) > b / (n_neg + 1), g, -g)


def labelled_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """l_id, toxic: at most `size` labelled learning rows, those of the smallest hashes."""
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    return one.filter("toxic = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))


def unlabelled_sample(docs: DataFrame, sample: DataFrame, size: int) -> DataFrame:
    """l_id of at most `size` learning documents outside the sample, those of the smallest hashes."""
    ids = docs.select(F.col("doc_id").cast("long").alias("l_id")).filter(F.col("l_id").isNotNull() & ~held_out(F.col("l_id"))).distinct()
    return ids.join(F.broadcast(sample.select("l_id")), "l_id", "left_anti").orderBy(F.xxhash64("l_id"), "l_id").limit(size)


def induce(docs: DataFrame, sample: DataFrame, size: int = FEATURES, support: int = 4) -> list[str]:
    """The features that speak most for toxicity in a sample (l_id, toxic), strongest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = Counter(), Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                by[toxic].update({f for w in words for f in features(w) if not f.endswith("!")})
            for toxic, c in enumerate(by):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"])

    own = texts(docs).select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("toxic", "text")
    counts = own.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return []
    # A bounded number reaches the driver; of these a prefix goes if a word or longer prefix under it has the same counts.
    lift = (F.col("pos") / n_pos) - (F.col("neg") / n_neg)
    top = counts.filter((F.col("pos") >= support) & (lift > 0)).withColumn("lift", lift).orderBy(F.desc("lift"), "feature").limit(16 * size).toPandas()
    top = top[~_repeated(top)]
    top["g2"] = _g2(top["pos"].to_numpy(), top["neg"].to_numpy(), n_pos, n_neg)
    top = top[top["g2"] > LEAST_G2].sort_values(["g2", "feature"], ascending=[False, True])
    return top["feature"].tolist()[:size]


def _repeated(top: pd.DataFrame) -> np.ndarray:
    """Whether a feature is a prefix of another one that occurs as often in either class."""
    rows = list(zip(top["feature"], top["pos"], top["neg"]))
    longer = {(f[:n] + "*", p, q) for f, p, q in rows for n in _PREFIXES if len(f.removesuffix("*")) > n}
    return np.array([r in longer for r in rows], bool)


def counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, idx and cnt: how often which of the named features occur in each text."""
    at = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {f[:4] for f in at if not f.endswith("!")}
        for batch in batches:
            idx, cnt = [], []
            for text in batch.column(1):
                words = Counter(_WORD.findall((text.as_py() or "").lower()))
                own: Counter = Counter()
                for w, n in words.items():
                    if w[:4] in heads or w in _LISTS:
                        for f in features(w):
                            if (i := at.get(f)) is not None:
                                own[i] += n
                keys = sorted(own)
                idx.append(keys)
                cnt.append([own[k] for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], names=["doc_id", "idx", "cnt"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, idx array<int>, cnt array<int>")


def _matrix(idx, cnt, width: int) -> np.ndarray:
    x = np.zeros((len(idx), width), np.float32)
    for r, (i, c) in enumerate(zip(idx, cnt)):
        x[r, np.asarray(i, int)] = c
    return x


class LabelModel:
    """Voters (feature and least count), how often each fires in either class, how often any does, and their correlations."""

    def __init__(self, voters: np.ndarray, least: np.ndarray, prior: float, fires: np.ndarray, speaks: np.ndarray):
        self.voters, self.least, self.prior, self.fires, self.speaks = voters, least, prior, fires, speaks  # fires: class x voter
        self.correlation = np.zeros((len(voters), len(voters)))

    def votes(self, masks: np.ndarray) -> np.ndarray:
        return (masks[:, None] >> np.arange(len(self.voters)) & 1).astype(np.float64)

    def logit(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxicity. A voter that fires speaks by its rates in the classes, and shares its voice with those it correlates with that fire too; a silent one abstains, and only that all are silent says something."""
        p = np.clip(self.fires, 1e-5, 1 - 1e-5)
        shared = 1 + votes @ np.clip(self.correlation, 0, 1)
        silent = np.log(1 - np.clip(self.speaks, 1e-3, 1 - 1e-3))
        return np.log(self.prior / (1 - self.prior)) + np.where(votes.any(axis=1), (votes / shared) @ np.log(p[1] / p[0]), silent[1] - silent[0])


def _sums(pdf: pd.DataFrame, model: LabelModel) -> np.ndarray:
    """Expected counts of rows (mask, gold, n) in one array: of both classes' documents and of those that any voter speaks for, then of each voter, then of each two of them together."""
    v, n = model.votes(pdf["mask"].to_numpy()), pdf["n"].to_numpy(float)
    gold = pdf["gold"].map({1: 1.0, 0: -1.0}).fillna(0).to_numpy(float) * np.log(GOLD / (1 - GOLD))
    p = 1 / (1 + np.exp(-np.clip(model.logit(v) + gold, -30, 30)))
    parts = []
    for w in (n * (1 - p), n * p):
        parts += [[w.sum(), w @ v.any(axis=1)], w @ v, (v.T @ (v * w[:, None])).ravel()]
    return np.concatenate([parts[0], parts[3], parts[1], parts[4], parts[2], parts[5]])


def fit_label_model(masks: DataFrame, model: LabelModel, anchor: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over masks (mask, gold, n): votes of the learning documents, their gold label (1, 0 or null), and how many are alike.

    Up to FEW_MASKS rows, which is what voters that mostly keep silent make, are summed where they were gathered once; more are summed in Spark.

    anchor: how many documents of either class the rates that `model` begins with count for, so that the classes keep their meaning.
    """
    j, first_fires, first_prior, first_speaks = len(model.voters), model.fires, model.prior, model.speaks
    few = masks.limit(FEW_MASKS + 1).toPandas()
    for r in range(rounds):
        if len(few) <= FEW_MASKS:
            total = sum((_sums(few.iloc[i : i + 20_000], model) for i in range(0, len(few), 20_000)), np.zeros(4 + 2 * j + 2 * j * j))
        else:

            def run(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
                own = sum((_sums(pdf, model) for pdf in batches), np.zeros(4 + 2 * j + 2 * j * j))
                yield pd.DataFrame({"at": np.arange(len(own)), "n": own})

            rows = masks.mapInPandas(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 2 (2 + j + j * j) rows
            total = np.zeros(4 + 2 * j + 2 * j * j)
            total[[x["at"] for x in rows]] = [x["n"] for x in rows]
        (weight, spoke), first, second = total[:4].reshape(2, 2).T, total[4 : 4 + 2 * j].reshape(2, j), total[4 + 2 * j :].reshape(2, j, j)
        fires = (first + anchor[:, None] * first_fires) / (weight + anchor)[:, None]
        speaks = (spoke + anchor * first_speaks) / (weight + anchor)
        prior = float(np.clip((weight[1] + first_prior * anchor.sum()) / (weight.sum() + anchor.sum()), 0.005, 0.5))
        new = LabelModel(model.voters, model.least, prior, fires, speaks)
        if weight.sum():  # correlations within the classes; the next round's votes are weighed by them
            for k, share in enumerate(weight / weight.sum()):
                mean = first[k] / max(weight[k], 1e-9)
                cov = second[k] / max(weight[k], 1e-9) - np.outer(mean, mean)
                sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
                new.correlation += share * cov / np.outer(sd, sd)
            np.fill_diagonal(new.correlation, 0)
        moved = max(np.abs(fires - model.fires).max(initial=0), abs(prior - model.prior))
        model = new
        if r and moved < SETTLED:
            break
    return model


def choose_voters(x: np.ndarray, y: np.ndarray, fixed: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and least counts of the voters: the fixed ones at a count of 1, then one by one the pattern and count that say most of the toxic rows, each row counting half as much for every voter it has."""
    steps = (1, 2, 3, 5, 8)
    voters, least = list(fixed), [1] * len(fixed)
    pos, neg = x[y == 1], x[y == 0]
    if len(pos) and len(neg):
        on = np.concatenate([pos >= t for t in steps], axis=1).astype(np.float32)
        silent = np.concatenate([(neg >= t).sum(axis=0) for t in steps])
        free = np.ones(on.shape[1], bool)
        free[[f + k * x.shape[1] for f in fixed for k in range(len(steps))]] = False
        weight = 0.5 ** (pos[:, fixed] >= 1).sum(axis=1).astype(np.float32)
        while len(voters) < size and free.any():
            gain = np.where(free, _g2(weight @ on, silent, len(pos), len(neg)), -np.inf)
            best = int(gain.argmax())
            if gain[best] < LEAST_G2 / 2:
                break
            voters.append(best % x.shape[1])
            least.append(steps[best // x.shape[1]])
            weight = np.where(on[:, best] > 0, weight / 2, weight)
            free[best % x.shape[1] :: x.shape[1]] = False
    return np.array(voters, int), np.array(least, int)


def fit_linear(x: np.ndarray, p: np.ndarray, penalty: float = 0.3, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels: weights, the last of them the intercept. Accelerated full-batch gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    keep = np.append(np.full(x.shape[1], penalty), 0.0)
    size = 0.25 * _largest(x1) + penalty
    w = old = np.zeros(x1.shape[1])
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - old)
        grad = x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30))) - p) + keep * ahead
        w, old = ahead - grad / size, w
    return w


def _largest(x: np.ndarray, steps: int = 20) -> float:
    """The largest eigenvalue of x'x, a little over."""
    v = np.ones(x.shape[1])
    for _ in range(steps):
        v = x.T @ (x @ (v / max(np.linalg.norm(v), 1e-12)))
    return 1.05 * float(np.linalg.norm(v)) + 1e-9


def _masks(table: DataFrame, sample: DataFrame, voters: np.ndarray, least: np.ndarray) -> DataFrame:
    """mask, gold and n: the votes of the learning documents of a table of counts, and how many are alike."""
    fired = F.lit(0).cast("long")
    for k, (f, t) in enumerate(zip(voters.tolist(), least.tolist())):
        fired = fired.bitwiseOR(F.when(F.col("c")[f] >= t, F.lit(1 << k)).otherwise(0).cast("long"))
    learning = table.filter(~held_out(F.col("doc_id"))).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"), "left")
    return learning.withColumn("c", F.map_from_arrays("idx", "cnt")).select(fired.alias("mask"), F.col("toxic").alias("gold")).groupBy("mask", "gold").agg(F.count("*").alias("n"))


class _Fitted:
    """A label model fitted on a table of counts, and its posterior for the documents of the samples."""

    def __init__(self, table: DataFrame, pool: DataFrame, sample: DataFrame, names: list[str], n_voters: int):
        # One row of each sampled document, however often it is there: bounded by the samples.
        rows = table.join(F.broadcast(pool), F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.first("toxic").alias("toxic"), F.min(F.struct("idx", "cnt")).alias("f")).select("l_id", "toxic", "f.*").toPandas()
        self.ids, self.gold = rows["l_id"].to_numpy(np.int64), rows["toxic"].map({1: 1.0, 0: -1.0}).fillna(0).to_numpy(float)
        self.x = _matrix(rows["idx"], rows["cnt"], len(names))
        known = self.gold != 0
        y = (self.gold[known] > 0).astype(int)
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        lists = [i for i, f in enumerate(names) if f.endswith("!")]
        voters, least = choose_voters(self.x[known], y, lists, n_voters)
        v = (self.x[known][:, voters] >= least).astype(float)
        assumed = np.array(RATES)[:, None] * np.ones(len(voters))
        rates = np.stack([(v[y == k].sum(axis=0) + assumed[k]) / (n[k] + 1) for k in (0, 1)])
        speaks = np.array([(v[y == k].any(axis=1).sum() + 1 - (1 - RATES[k]) ** len(lists)) / (n[k] + 1) for k in (0, 1)])
        prior = float(np.clip(y.mean(), 0.005, 0.5)) if n.all() else PRIOR
        # Gold weighs a tenth here, beside its own votes below.
        self.model = fit_label_model(written(_masks(table, sample, voters, least), "toxicity-votes"), LabelModel(voters, least, prior, rates, speaks), 0.1 * n + 10)
        logit = self.model.logit(self.votes().astype(float)) + self.gold * np.log(GOLD / (1 - GOLD))
        self.posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def votes(self) -> np.ndarray:
        return self.x[:, self.model.voters] >= self.model.least


def score(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, size: int = FEATURES, n_voters: int = VOTERS) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = written(labelled_sample(labels, sample_size), "toxicity-sample")
    others = unlabelled_sample(docs, sample, sample_size // 2).select("l_id", F.lit(None).cast("int").alias("toxic"))
    pool = written(sample.unionByName(others), "toxicity-pool")
    lists = [f"{lang}!" for lang in sorted(LEXICON)]

    names = lists + induce(docs, sample, size)
    own = docs.join(F.broadcast(pool), F.col("doc_id") == F.col("l_id")).select("doc_id", "text")
    first = _Fitted(written(counted(own, names), "toxicity-pool-counts"), pool, sample, names, n_voters)
    sure = (first.gold != 0) | (first.posterior >= SURE) | (first.posterior <= 1 - SURE)
    guessed = [(int(i), int(g > 0 if g else p > 0.5)) for i, g, p in zip(first.ids[sure], first.gold[sure], first.posterior[sure])]
    names = lists + induce(docs, spark.createDataFrame(guessed, "l_id long, toxic int"), size)

    table = written(counted(docs, names), "toxicity-counts")
    fitted = _Fitted(table, pool, sample, names, n_voters)
    voters, least = fitted.model.voters, fitted.model.least
    weights = fit_linear(np.hstack([np.log1p(fitted.x), fitted.votes().astype(np.float32)]), fitted.posterior)
    by_count, by_vote, bias = weights[: len(names)], np.zeros(len(names)), weights[-1]
    by_vote[voters] = weights[len(names) : -1]
    from_count = np.ones(len(names), int)
    from_count[voters] = least
    numbers = lambda values, kind: F.array(*[F.lit(kind(a)) for a in values])

    def add(total, s):
        i = s["idx"]
        return total + F.get(F.col("w"), i) * F.log1p(s["cnt"]) + F.when(s["cnt"] >= F.get(F.col("t"), i), F.get(F.col("v"), i)).otherwise(0.0)

    z = F.aggregate(F.arrays_zip("idx", "cnt"), F.lit(float(bias)), add)
    return table.withColumns({"w": numbers(by_count, float), "v": numbers(by_vote, float), "t": numbers(from_count, int)}).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
