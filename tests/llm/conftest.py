import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns whose names clash with those the operators use inside."""

    def run(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit("clash") for c in ("row_key", "fp", "score", "at", "h1", "pos", "base", "start", "row", "_row", "nd_row", "dc_row", "ll_row", "ll_key", "lost_id", "lost_row", "hit_id", "b_row", "keep", "key", "prefix", "sig", "kept_id", "found", "value", "token", "feature", "toxic", "l_id")})

    return run


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, blank, repeated and very long texts, ties, and a null id."""
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "same text here for all of us"), (5, "same text here for all of us"), (5, "same text here for all of us"), (6, long), (None, "no id at all"), (7, "12345 !!!"), (8, "日本語 🙂 naïve é x")]
