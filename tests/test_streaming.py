from pyspark.sql import functions as F

from checks import DATA
from loomline.operators import ingest, limits
from loomline.sources import parsers
from loomline.streaming import ingest as stream


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(3):
        (landing / f"{i}.txt").write_text(f"text {i} " * 300)
    (landing / "bad.txt").write_bytes(b"\xff")
    run = lambda: stream.ingest_folder(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (landing / "late.md").write_text("later")
    run()
    out = spark.read.parquet(str(tmp_path / "out/documents"))
    batch = ingest.processed(parsers.read_files(spark, str(landing)).withColumn("doc_id", F.md5("file_name")))
    columns = ["doc_id", "file_name", "status", "chunk_count"]
    assert sorted(out.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert spark.read.parquet(str(tmp_path / "out/vectors")).count() == out.agg(F.sum("chunk_count")).first()[0]


def test_streamed_rate_limit_equals_batch(spark, tmp_path):
    hits = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hits.coalesce(1).write.parquet(str(tmp_path / "hits"))
    source = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    q = stream.rate_limited_stream(source, ["user_id", "event_type"], "us", 86_400, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    batch = limits.sliding_window(hits, ["user_id", "event_type"], "us", 86_400, F.lit(2))
    assert sorted(spark.table("limited").collect()) == sorted(batch.collect())


def test_hits_per_window(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = stream.hits_per_window(source, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
