"""What of texts lies in a Python worker at once."""

import pytest

import __spark_entry__ as entry
from checks import DATA
from loomline.operators.shared import small_batches

KEYS = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]


@pytest.fixture(autouse=True)
def unset(spark):
    for k in KEYS:
        spark.conf.unset(k)
    yield
    for k in KEYS:
        spark.conf.unset(k)


def rows_of_batches(df):
    import pyarrow as pa

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int32())})

    return [r.n for r in df.mapInArrow(count, "n int").collect()]


@pytest.mark.parametrize("name", ["chunks_per_document", "chunk_documents", "chunk_vector_ids"])
def test_texts_are_chunked_once(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert int(spark.conf.get(KEYS[0])) <= 1000


def test_long_texts_make_shorter_batches(spark):
    texts = spark.range(0, 900, 1, 1).selectExpr("repeat('x', 100000) as text")
    assert max(rows_of_batches(texts)) > 600  # 64 MB
    n = rows_of_batches(small_batches(texts))
    assert sum(n) == 900 and max(n) <= 90


def test_lower_settings_stay(spark):
    spark.conf.set(KEYS[0], 7)
    spark.conf.set(KEYS[1], "1m")
    small_batches(spark.range(1))
    assert [spark.conf.get(k) for k in KEYS] == ["7", "1m"]


@pytest.mark.parametrize("name", ["document_states", "ingest_documents", "knowledge_base_counters"])
def test_documents_come_in_small_batches(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert int(spark.conf.get(KEYS[0])) <= 1000
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_an_embedder_gets_small_batches(spark, tmp_path):
    from loomline.operators import vector

    log = str(tmp_path / "log")

    def embedder(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[1.0, 0.0] for _ in texts]

    df = spark.range(0, 5000, 1, 1).selectExpr("cast(id as string) as t")
    assert vector.embed(df, "t", embedder, 2).agg({"embedding": "max"}).count() == 1
    vector.embed(df, "t", embedder, 2).write.format("noop").mode("overwrite").save()
    sizes = [int(x) for x in open(log)]
    assert max(sizes) <= 1000 and sum(sizes) % 5000 == 0


def test_levels_broadcast_nothing(spark):
    from loomline.operators import workflow

    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    before = max((x.executionId() for x in ran()), default=-1)
    nodes = spark.range(40)
    got = workflow.levels(nodes, nodes.selectExpr("id as src", "2 * id + 1 as dst")).collect()
    assert {r.id: r.level for r in got} == {i: depth(i) for i in range(40)}
    plans = [x.physicalPlanDescription() for x in ran() if x.executionId() > before]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def depth(i):
    return 0 if i % 2 == 0 else 1 + depth((i - 1) // 2)


def test_a_base_is_chunked_and_embedded_once(spark):
    from loomline.operators import ingest

    d = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "cast(null as string) as error")
    plan = ingest.vectors(ingest.processed(d))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and int(spark.conf.get(KEYS[0])) <= 1000


@pytest.mark.parametrize("text", ["字" * 1_000_000, "sieben " * 400_000, "kurze Zeile\n" * 200_000], ids=["no separator", "words", "lines"])
def test_a_long_text_is_not_taken_apart(text):
    import tracemalloc

    from loomline.operators.chunking import chunked

    tracemalloc.start()
    try:
        assert len(chunked(text)) > 900
        assert tracemalloc.get_traced_memory()[1] < 3 * len(text.encode())
    finally:
        tracemalloc.stop()


def split_up(text, size, separators):
    """Chunks by lists of pieces, as plainly as can be."""
    at = next(i for i, s in enumerate(separators) if s in text)
    separator, rest = separators[at], separators[at + 1 :]
    chunks, now = [], ""
    for piece in text.split(separator) if separator else text:
        if len(piece) >= size:
            chunks += [now, *(split_up(piece, size, rest) if rest else [piece])]
            now = ""
        elif now and len(now) + len(separator) + len(piece) <= size:
            now += separator + piece
        else:
            chunks.append(now)
            now = piece
    return [c for c in map(str.strip, [*chunks, now]) if c]


def test_slices_are_the_pieces_joined():
    import random

    from loomline.operators.chunking import SEPARATORS, chunked

    r = random.Random(7)
    for _ in range(20_000):
        text, size = "".join(r.choices("ab \n\n，。\tc字", k=r.randrange(40))), r.randrange(1, 13)
        for ladder in (SEPARATORS, (" ", ""), ("ab", "a", "")):
            assert chunked(text, size, ladder) == split_up(text, size, ladder), (text, size, ladder)
