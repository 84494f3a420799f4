import json
import time

import pytest
from pyspark.sql import functions as F

from checks import DATA
from loomline.plans.governance import token_blacklist
from loomline.streaming import tokens

WEEK = 7 * 86_400


def test_spans():
    assert tokens.merged([(5, 9), (1, 3), (3, 4), (8, 12), (20, 20)]) == [(1, 4), (5, 12)]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run(checked, path):
    """One batch: with a time to live, a trigger of what is available would go on with empty batches."""
    q = checked.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(once=True).start()
    q.awaitTermination(120)
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_stream_equals_the_batch_query(spark, tmp_path, rocksdb):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", at.alias("at"), (F.expr("event_type = 'error' and value > 50")).alias("revokes"))
    middle = e.agg(F.percentile_approx("at", 0.5)).first()[0]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    revoked = source.filter("revokes").select(F.col("user_id").alias("token"), "at", (F.col("at") + WEEK * 1_000_000).alias("until"))
    asked = source.select(F.col("user_id").alias("token"), F.col("event_id").alias("request"), "at")
    for i, part in enumerate((e.filter(F.col("at") <= middle), e.filter(F.col("at") > middle))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        held = run(tokens.requests_checked(revoked, asked, WEEK), tmp_path)
    assert held == e.filter("revokes").select("user_id").distinct().count()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == e.count()
    assert {r.request for r in out.filter("not listed").collect()} == {r.event_id for r in token_blacklist(spark, DATA).collect()}


def test_state_goes_when_it_has_lived(spark, tmp_path, rocksdb):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("kind string, token string, at long, until long, request long").json(str(tmp_path / "in"))
    checked = tokens.requests_checked(source.filter("kind = 'revoke'").select("token", "at", "until"), source.filter("kind = 'ask'").select("token", "request", "at"), 2)

    def batch(n, *rows):
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, rows)))
        held = run(checked, tmp_path)
        return {r.request: r.listed for r in spark.read.parquet(str(tmp_path / "out")).collect()}, held

    first = [{"kind": "revoke", "token": f"t{i}", "at": 10, "until": 10**9} for i in range(20)]
    rows, held = batch(1, *first, {"kind": "ask", "token": "t3", "at": 5, "request": 1}, {"kind": "ask", "token": "t4", "at": 11, "request": 2})
    assert rows == {1: False, 2: True} and held == 20
    time.sleep(3)
    rows, held = batch(2, {"kind": "ask", "token": "t4", "at": 12, "request": 3}, {"kind": "ask", "token": "t5", "at": 12, "request": 4})
    assert rows == {1: False, 2: True, 3: False, 4: False} and held == 0
