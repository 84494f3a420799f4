import uuid

import pytest
from pyspark.sql import functions as F

from loomline.functions import scalar as S


def one(spark, column, row=None):
    return spark.range(1).select(column.alias("x")).first().x


def test_variables_and_render(spark):
    content = F.lit("{{b}} {{a}} {{b}} {{ c }} {{naïve}}")
    assert one(spark, S.variables(content)) == ["b", "a", "naïve"]
    entries = lambda *kv: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in kv])
    assert one(spark, S.render(F.lit("{{a}}{{b}}"), entries(("a", "{{b}}"), ("b", "1")))) == "11"
    assert one(spark, S.render(F.lit("{{a}}{{b}}"), entries(("b", "1"), ("a", "{{b}}")))) == "{{b}}1"
    assert one(spark, S.render(F.lit("{{a}}{{b}}"), entries(("b", "1"), ("z", "2")))) is None
    assert one(spark, S.render_error(F.lit("{{x}} {{b}} {{y}}"), entries(("b", "1")))) == "missing variables: x, y"


@pytest.mark.parametrize("name", ["1_0", "42_7", "文_1", ""])
def test_uuid5(spark, name):
    assert one(spark, S.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_vector_size(spark):
    assert one(spark, S.vector_size(F.lit("BAAI/bge-m3"))) == 1024
    assert one(spark, S.vector_size(F.lit(" bge-large "))) == 1024
    for bad in ("", "text-embedding-3-small"):
        with pytest.raises(Exception, match="model"):
            one(spark, S.vector_size(F.lit(bad)))


def test_encryption(spark):
    text, key = F.lit("secret ключ"), F.lit("a key")
    assert one(spark, S.decrypted(S.encrypted(text, key), key)) == "secret ключ"
    a, b = spark.createDataFrame([("same",), ("same",)], "t string").select(S.encrypted(F.col("t"), key).alias("x")).collect()
    assert a.x != b.x
    with pytest.raises(Exception):  # noqa: B017  a wrong key
        one(spark, S.decrypted(S.encrypted(text, key), F.lit("another")))
    with pytest.raises(Exception, match="not configured"):
        one(spark, S.encrypted(text, F.lit("")))


def test_small_helpers(spark):
    assert one(spark, S.strip(F.lit("　 a b\t\n"))) == "a b"
    assert one(spark, S.split_literal(F.lit("a..b.."), "..")) == ["a", "b", ""]
    assert one(spark, S.client_ip(F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("string"))) == "unknown"
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert [one(spark, S.backoff_seconds(F.lit(n))) for n in range(4)] == [1, 2, 4, 5]
    assert one(spark, S.masked(F.lit(""))) is False


def test_encryption_round_trip(spark):
    df = spark.createDataFrame([("sk-secret ü",), ("",), (None,)], "t string")
    key = F.lit("0123456789abcdef")
    rows = df.select("t", S.encrypted(F.col("t"), key).alias("c")).withColumn("back", S.decrypted(F.col("c"), key)).collect()
    again = df.select(S.encrypted(F.col("t"), key).alias("c")).first().c
    assert all(r.t == r.back for r in rows) and rows[0].c != again and "secret" not in rows[0].c
    assert [r.m for r in df.select(S.masked(F.col("t")).alias("m")).collect()] == [True, False, False]
    for bad in (F.lit(""), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="not configured"):
            df.select(S.encrypted(F.col("t"), bad)).collect()
    with pytest.raises(Exception):
        df.select(S.decrypted(S.encrypted(F.col("t"), key), F.lit("another"))).collect()
