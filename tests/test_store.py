from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.sources import store as S

TABLES = {"chunks": ("chunk_id", "doc_id"), "vectors": ("chunk_id", "doc_id")}


def chunks(spark, docs, text):
    rows = spark.createDataFrame([(f"{d}_{i}", d, f"{text} {d} {i}") for d in docs for i in range(3)], "chunk_id string, doc_id long, content string")
    return {"chunks": rows, "vectors": rows.select("chunk_id", "doc_id", F.array(F.length("content").cast("float")).alias("embedding"))}


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*.parquet")}


def content(store):
    return {r.chunk_id: r.content for r in store.read("chunks").collect()}


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), TABLES, 16)
    assert store.read("chunks") is None and store.manifest()["version"] == 0
    assert store.upsert(chunks(spark, range(40), "a")) == 1
    before, live = files(tmp_path / "s"), store.manifest()["tables"]["chunks"]["live"]
    assert store.upsert(chunks(spark, [3, 100], "b")) == 2
    now = store.manifest()["tables"]["chunks"]["live"]
    changed = {b for b in now if now[b] != live.get(b)}
    assert 1 <= len(changed) <= 2 and before < files(tmp_path / "s")
    assert content(store) == {f"{d}_{i}": f"{'b' if d in (3, 100) else 'a'} {d} {i}" for d in [*range(40), 100] for i in range(3)}
    used = {f.split("/s/")[1] for f in store.read("chunks").inputFiles()}
    assert {f for f in used if not any(f"={b}/" in f for b in changed)} <= before
    # Fewer chunks of a document: all its old ones go.
    fewer = {t: df.filter("doc_id = 3 and chunk_id = '3_1'") for t, df in chunks(spark, [3], "c").items()}
    store.upsert(fewer, "replace")
    assert {k for k in content(store) if k.startswith("3_")} == {"3_1"} and store.read("vectors").filter("doc_id = 3").count() == 1


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "s"), TABLES, 4)
    store.upsert(chunks(spark, range(5), "a"))
    old = content(store)

    def died(manifest):
        raise OSError("killed")

    monkeypatch.setattr(store, "_commit", died)
    with pytest.raises(OSError):
        store.upsert(chunks(spark, range(5), "b"))  # both tables are written by now
    again = S.Store(spark, str(tmp_path / "s"), TABLES, 4)
    assert content(again) == old and again.read("vectors").count() == 15 and again.manifest()["version"] == 1
    monkeypatch.undo()
    assert store.upsert(chunks(spark, range(5), "b")) == 2 and set(content(store).values()) == {f"b {d} {i}" for d in range(5) for i in range(3)}


def test_two_writers(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), TABLES, 4)
    stale = store.manifest()
    store.upsert(chunks(spark, [1], "a"))
    stale["version"] += 1
    with pytest.raises(S.ConcurrentUpsert):
        store._commit(stale)
    assert store.manifest()["version"] == 1 and set(content(store)) == {"1_0", "1_1", "1_2"}
    with pytest.raises(ValueError):
        S.Store(spark, str(tmp_path / "s"), TABLES, 8).upsert(chunks(spark, [1], "a"))
    with pytest.raises(ValueError):
        store.upsert({"chunks": chunks(spark, [1], "a")["vectors"]})


def test_rows_without_a_key(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"), {"t": ("k", "k")}, 4)
    rows = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4)], "k string, v long")
    store.upsert({"t": rows})
    store.upsert({"t": rows.filter("v = 2")})
    assert sorted(r.v for r in store.read("t").filter("k is null").collect()) == [1, 2, 2] and store.read("t").filter("k = 'x'").count() == 1
