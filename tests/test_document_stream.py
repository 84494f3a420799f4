import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.sources.uploads import Uploads, error_of
from loomline.streaming import documents


def put(path, n, *events):
    lines = [json.dumps({"event_id": i, "doc_id": d, "status": s, "error_message": m, "at": f"2024-01-01T{t}Z"}) for i, d, s, m, t in events]
    (path / f"{n}.json").write_text("\n".join(lines))


def test_documents_end_once(spark, tmp_path):
    told = tmp_path / "told"
    told.mkdir()
    source = spark.readStream.schema("event_id string, doc_id long, status string, error_message string, at timestamp").json(str(told))

    def run():
        q = documents.outcomes(source, 600, "1 minute", 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        return {r.doc_id: (r.status, r.error_message, r.steps, f"{r.at:%H:%M:%S}") for r in rows}

    put(told, 1, ("a", 1, "pending", None, "10:00:00"), ("b", 1, "processing", None, "10:00:10"), ("c", 1, "completed", None, "10:00:20"), ("c", 1, "completed", None, "10:00:20"), ("d", 2, "pending", None, "10:00:00"), ("e", 2, "processing", None, "10:00:30"), ("f", 3, "failed", "no chunks", "10:00:05"), ("g", 4, "pending", None, "10:00:00"), ("x", 5, "odd", None, "10:00:00"), ("y", None, "pending", None, "10:00:00"))
    got = run()
    assert got == {1: ("completed", None, 2, "10:00:20"), 3: ("failed", "no chunks", 0, "10:00:05")}
    # A replay, an event of a document that has ended, and one that goes on; time passes for the rest.
    put(told, 2, ("c", 1, "completed", None, "10:00:20"), ("h", 1, "failed", "late", "10:02:00"), ("i", 4, "processing", None, "10:09:00"), ("z", 6, "pending", None, "10:14:00"))
    got = run()
    assert got[2] == ("failed", "no news for 600 seconds in processing", 2, "10:10:30") and set(got) == {1, 2, 3}
    put(told, 3, ("j", 4, "completed", None, "10:15:00"), ("k", 2, "completed", None, "10:16:00"), ("l", 6, "processing", None, "10:16:00"))
    got = run()
    assert got[4] == ("completed", None, 2, "10:15:00") and got[2][0] == "failed" and set(got) == {1, 2, 3, 4}


@pytest.fixture
def uploads(spark):
    spark.dataSource.register(Uploads)
    return spark


def test_uploads_are_claimed_once(uploads, tmp_path):
    spark, landing = uploads, tmp_path / "landing"

    def land(name, text):
        (landing / name).parent.mkdir(parents=True, exist_ok=True)
        (landing / name).write_text(text)

    def run(fail=False):
        source = spark.readStream.format("uploads").option("landing", str(landing)).option("dest", str(tmp_path / "dest")).option("content", "true").load()

        def write(batch, number):
            if fail:
                raise OSError("killed")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"rows/batch={number}"))

        q = source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {(r.tenant, r.kb, r.file_name): r for r in spark.read.parquet(str(tmp_path / "rows")).collect()}

    land("7/1/a.TXT", "hello")
    land("7/1/b.exe", "x")
    land("8/2/empty.md", "")
    land("8/2/.part", "being written")
    rows = run()
    assert {k: (r.status, r.error_message, r.file_size) for k, r in rows.items()} == {("7", "1", "a.TXT"): ("pending", None, 5), ("7", "1", "b.exe"): ("refused", "unsupported type: exe", 1), ("8", "2", "empty.md"): ("refused", "empty file", 0)}
    a = rows["7", "1", "a.TXT"]
    assert bytes(a.content) == b"hello" and Path(a.file_url).read_text() == "hello" and [f.name for f in landing.rglob("*") if f.is_file()] == [".part"]
    # A batch that dies after its files were claimed is run again with the same rows; the next upload of a name is another document.
    land("7/1/a.TXT", "again")
    with pytest.raises(Exception, match="killed"):
        run(fail=True)
    assert len(spark.read.parquet(str(tmp_path / "rows")).collect()) == 3
    rows = spark.read.parquet(str(tmp_path / "rows")) if run() else None
    assert rows.count() == 4 and rows.select("doc_id").distinct().count() == 4 and rows.filter("claim = 2").count() == 1
    run()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    everything = spark.read.format("uploads").option("landing", str(landing)).option("dest", str(tmp_path / "dest")).load()
    assert everything.count() == 4 and everything.agg(F.count("content")).first()[0] == 0
    assert spark.read.format("uploads").option("landing", str(landing)).option("dest", str(tmp_path / "none")).load().count() == 0
    assert error_of("noext", 3) == "unsupported type: "
