"""A corpus from documents to packed sequences: language, lines, near-duplicates, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it
was given, the last the pieces of packed sequences. Between stages docs are
written as Parquet and read again, so a lost executor costs one stage's tasks.

Defined results: null, empty and blank texts have no language and go; a null
doc_id is kept like any other, and n_chars follows a text that lost lines; of
repeated rows one stays; extra columns of any name pass through all stages but
the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontam, langid, line_dedup, near_copies, packing
from loomline.llm.common import unused, written

#: Similarity of a text's n-gram ranks to the nearest language's, under which it is in none of them (real texts of a learnt language have 0.35 and more).
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages learnt stay, with that language in `lang`; text without a letter, or unlike all profiles, goes."""
    pred, score = unused(docs, "lang_pred", "score")
    found = langid.identify(docs, into=(pred, score))
    found = found.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    if "lang" in docs.columns:
        found = found.withColumn("lang", F.col(pred))
    return found.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, into=tuple(unused(docs, "ll_n_lines", "ll_n_dropped"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: SimHash's trie walk, and prefix filtering for what lies beyond its radius."""
    return near_copies.drop_near_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays is packed into sequences of 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language ID", language_id), ("line dedup", lines), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", benchmarks), ("packing", pack)]

#: SQL can't express the stages of language, fingerprints and packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
