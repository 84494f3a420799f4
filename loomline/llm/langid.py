"""Language ID by rank-order n-gram profiles.

A language's profile is its most frequent n-grams of letters (words padded with a
space at each end), most frequent first. A document's own profile is compared to
each by the out-of-place distance: for each of its n-grams the difference of the
two ranks, or the profile length where the language lacks it.

Learning counts the n-grams of all learning documents: inside a task per batch,
then by one shuffle of these counts; of the result only the top of each language
reaches the driver (languages x profile length rows). Prediction reads each text
once and shuffles nothing.

Defined results: null text and text without a letter are `und` with score 0; ties
of counts go to the smaller n-gram, ties of distance to the smaller language
name; documents without a language, or held out, teach nothing; with nothing
learned all is `und`; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, texts, unused

PROFILE, LONGEST, UNKNOWN = 300, 3, "und"
#: Letters that a task holds before it counts them.
COUNTED_AT_ONCE = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of a text in lower case, with one 0 before, between and after its words; empty without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code = np.concatenate([[0], np.where(_letters()[code], code, 0), [0]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code = code[keep]
    return code if len(code) > 1 else code[:0]


def grams(code: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """All n-grams of 1 to `longest` (at most 3) letters, 21 bits a letter; a word's edge counts as a letter of those of 2 and more."""
    out = [code[code != 0]]
    if longest >= 2 and len(code) > 1:
        out.append(1 << 42 | code[:-1] << 21 | code[1:])
    if longest >= 3 and len(code) > 2:
        inner = code[1:-1] != 0
        out.append((code[:-2] << 42 | code[1:-1] << 21 | code[2:])[inner] | np.int64(-(2**63)))
    return np.concatenate(out)


def profile(code: np.ndarray, longest: int = LONGEST, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    gram, n = np.unique(grams(code, longest), return_counts=True)
    return gram[np.argsort(-n, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = PROFILE, longest: int = LONGEST) -> pd.DataFrame:
    """Profiles of the languages in `lang`: columns lang, gram, rank (from 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(lang: str, codes: list[np.ndarray]) -> pa.RecordBatch:
            gram, n = np.unique(grams(np.concatenate(codes), longest), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        own: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = letters(text.as_py())
                own.setdefault(lang, []).append(code)
                held[lang] = held.get(lang, 0) + len(code)
                if sum(held.values()) > COUNTED_AT_ONCE:
                    yield from (told(*x) for x in own.items())
                    own, held = {}, {}
        yield from (told(*x) for x in own.items())

    counts = texts(docs).filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    # Two words meet as 0, 0 where texts do; no n-gram of one text.
    counts = counts.filter(F.col("gram") != 1 << 42).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank").toPandas()


def predict(docs: DataFrame, profiles: pd.DataFrame, size: int = PROFILE, longest: int = LONGEST, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a prediction and its score (1 less the distance as a share of the largest possible). Columns called as `into` says are replaced; a caller that has such columns names others."""
    names = sorted(profiles["lang"].unique())
    known = np.unique(profiles["gram"].to_numpy(np.int64))
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)
    for i, name in enumerate(names):
        own = profiles[profiles["lang"] == name]
        ranks[np.searchsorted(known, own["gram"].to_numpy(np.int64)), i] = own["rank"].to_numpy(np.int64)

    def one(text: str | None) -> tuple[str, float]:
        code = letters(text)
        if not len(code) or not names:
            return UNKNOWN, 0.0
        own = profile(code, longest, size)
        at = np.searchsorted(known, own)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own), at, len(known))
        rank = ranks[at]
        distance = np.where(rank < 0, size, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return names[best], 1 - distance[best] / (size * len(own))

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    # Marked so, a filter on the result isn't pushed below it, which would make every prediction twice.
    got = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()(F.col("text"))
    (at,) = unused(docs, "prediction")
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    return texts(docs).withColumn(at, got).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{at}`.lang_pred").alias(into[0]), F.col(f"`{at}`.score").alias(into[1]))


def identify(docs: DataFrame, size: int = PROFILE, longest: int = LONGEST, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with a prediction and its score, by profiles of the documents that are not held out."""
    return predict(docs, learn(docs.filter(~held_out(F.col("doc_id"))), size, longest), size, longest, into)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
