import pytest

from loomline.functions.register import register
from loomline.operators.chunking import chunked
from loomline.sources import sinks


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("select cosine_score(array(1f, 0f), array(1f, 1f)) as c, cosine_score(array(0f), array(1f)) as none, template_variables('{{b}} {{é}} {{b}} {{ x }}') as v").first()
    assert row.c == pytest.approx(0.5**0.5) and row.none is None and row.v == ["b", "é"]
    text = "words and more " * 300
    spark.createDataFrame([(1, text), (2, None)], "id long, t string").createOrReplaceTempView("sql_docs")
    out = spark.sql("select id, c.* from sql_docs, lateral chunk_text(t) c order by chunk_index").collect()
    assert [r.content for r in out] == chunked(text)


def test_sinks(spark, tmp_path):
    df = spark.sql("select 1 as id, timestamp_ntz '2024-01-02 03:04:05' as at, 'a,b' as text")
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("1", "2024-01-02T03:04:05", "a,b")]
    for _ in range(2):
        sinks.append(df, str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    tokens = spark.createDataFrame([("a", 100), ("b", 10), ("c", None)], "token string, exp long")
    assert {(r.token, r.expires_at) for r in sinks.blacklist(tokens, 50).collect()} == {("a", 100), ("b", 51)}
