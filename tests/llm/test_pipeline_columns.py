from pyspark.sql import functions as F

#: Names that stages give columns of their own, or did once.
NAMES = ("_lid", "prediction", "lang_pred", "Score", "ll_n_lines", "ll_n_dropped", "row", "key", "hash", "comp", "first", "sig", "b_id", "keep", "hit_id", "no_id", "o_key", "s_id", "doc_tokens")


def test_every_stage_keeps_the_callers_columns(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river bank today")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, f"this is the {i}th text of them all and it says word{i} about thing{i} to you and me\nand a second line with number {i * i}", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.concat(F.lit("mine "), F.col("doc_id").cast("string")) for c in NAMES})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == 30 and all(r[c] == f"mine {r.doc_id}" for r in got for c in NAMES)
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 30
