import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import scalar
from loomline.operators import chunking, ingest, relational, vector, workflow
from loomline.operators.prompts import invoked
from loomline.sources import parsers


@pytest.mark.parametrize(
    ("text", "want"),
    [("aaaa bbbb cccc", ["aaaa bbbb", "cccc"]), ("a" * 10, ["a" * 10]), ("a" * 10 + " b", ["a" * 10, "b"]), ("\n\naa\n\nbb", ["aa\n\nbb"]), ("a" * 11, ["a" * 10, "a"]), ("   ", [])],
)
def test_chunk_vectors(text, want):
    assert chunking.chunked(text, 10) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n。，", max_size=80), st.integers(2, 12))
def test_chunks_hold_all_letters_in_order(text, size):
    out = chunking.chunked(text, size)
    assert all(0 < len(c) <= size and c == c.strip() for c in out)
    letters = lambda s: [x for x in s if x in "ab"]
    assert letters("".join(out)) == letters(text)


def test_ladder_without_code_points():
    with pytest.raises(ValueError):
        chunking.chunked("a" * 20, 10, ("\n\n",))


def docx(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    return buffer.getvalue()


def test_files_and_ingestion(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello wörld")
    (tmp_path / "b.md").write_text("# title\n\ntext")
    (tmp_path / "c.docx").write_bytes(docx(" one", "  ", "two"))
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.exe").write_bytes(b"x")
    (tmp_path / "g.txt").write_text(" \n ")
    files = parsers.read_files(spark, str(tmp_path)).withColumn("doc_id", F.col("file_name"))
    rows = {r.file_name: r for r in ingest.processed(files).collect()}
    assert rows["a.TXT"].text == "hello wörld" and rows["b.md"].text == "# title\n\ntext" and rows["c.docx"].text == " one\ntwo"
    assert {n: r.status for n, r in rows.items()} == {"a.TXT": "completed", "b.md": "completed", "c.docx": "completed", "d.txt": "failed", "e.docx": "failed", "f.exe": "failed", "g.txt": "failed"}
    assert "unsupported" in rows["f.exe"].error_message and rows["g.txt"].error_message == "document is empty"


def test_retries():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("cut off")
        return x

    assert vector.retrying(flaky, wait=waits.append)(1) == 1 and waits == [1, 2]
    with pytest.raises(OSError):
        vector.retrying(lambda: (_ for _ in ()).throw(OSError()), wait=waits.append)()


def test_top_k_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 2.0]), (6, [])], "vec_id long, embedding array<float>")
    hits = vector.top_k(v, v, k=1, threshold=0.5, block=2).collect()
    assert sorted((h.query_id, h.vec_id, h.score, h.rank) for h in hits) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert vector.top_k(v.limit(0), v).count() == 0


def test_workflow_with_a_cycle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (4, 5), (9, 6)], "src long, dst long")
    assert {r.id: r.level for r in workflow.levels(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 6: 0}


def test_ancestors(spark):
    nodes = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "id long, parent long")
    assert all(r.root == 1 and r.depth == r.id - 1 for r in workflow.ancestors(nodes).collect())


def test_tenant_scope_rejects_bad_pages(spark):
    scope = relational.TenantScope(spark.createDataFrame([(1, 1)], "id long, tenant_id long"), 1)
    assert scope.page(1, 10, "id").collect() == [(1, 1, 1)]
    assert scope.page(2, 10, "id").count() == 0 and scope.page(2, 10, "id", keep_total=True).collect() == [(None, None, 1)]
    for page, size in ((0, 10), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            scope.page(page, size, "id")


def test_invoked_errors_are_rows(spark):
    df = spark.createDataFrame([("a",), ("",)], "t string")
    rows = invoked(df, "t", lambda t: {"content": t.upper()} if t else 1 / 0).collect()
    assert [(r.result_content, r.prompt_tokens, r.status) for r in rows] == [("A", 0, "success"), (None, 0, "error")]


def test_search_by_text(spark):
    texts = ["red apples and pears", "steam engines", "pears and red apples"]
    chunks = spark.createDataFrame([(i, 7, i, t) for i, t in enumerate(texts)], "vec_id long, doc_id long, chunk_index int, content string")
    documents = spark.createDataFrame([(7, "a.txt", True)], "doc_id long, doc_name string, deleted boolean")
    vectors = vector.embed(chunks.select("vec_id", "content"), "content", vector.hashing_embedder(), 64).select("vec_id", "embedding")
    questions = spark.createDataFrame([(100, "red apples and pears")], "query_id long, question string")
    hits = vector.search(vectors, chunks, documents, questions, top_k_=2).orderBy("rank").collect()
    assert [(h.vec_id, h.doc_name, h.score) for h in hits] == [(0, "a.txt", 1.0), (2, "a.txt", 1.0)]
    assert vector.search(vectors, chunks, documents, questions, strict=True).count() == 0
    for bad in ({"top_k_": 0}, {"top_k_": 51}, {"score_threshold": 1.5}):
        with pytest.raises(ValueError):
            vector.search(vectors, chunks, documents, questions, **bad)


def test_upsert_keeps_rows_without_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "id long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (None, "z")], "id long, v string")
    assert sorted(relational.upserted(old, new, "id").collect(), key=str) == sorted([(1, "x"), (2, "y"), (None, "b"), (None, "c"), (None, "z"), (None, "z")], key=str)


def test_vectors_of_other_sizes_and_many_queries(spark, monkeypatch):
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)] + [(100, [1.0, 2.0]), (101, None), (102, []), (103, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    few = sorted(vector.top_k(v, v, k=4, threshold=0.2).collect())
    monkeypatch.setattr(vector, "QUERIES", 3)
    assert sorted(vector.top_k(v, v, k=4, threshold=0.2, block=7).collect()) == few and len(few) == 160
    assert {(r.vec_id, r["size"]) for r in vector.of_other_size(v, 3).collect()} == {(100, 2), (101, -1), (102, 0)}


def test_ancestors_on_cycles_and_long_chains(spark):
    chain = [(i, i - 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (0, None)]
    got = {r.id: (r.root, r.depth) for r in workflow.ancestors(spark.createDataFrame(chain, "id long, parent long")).collect()}
    assert got == {i: (0, i) for i in range(300)}
    edges = spark.createDataFrame([(i - 1, i) for i in range(1, 12)] + [(20, 21), (21, 20), (21, 22)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (*range(12), 20, 21, 22)], "id long")
    assert {r.id: r.level for r in workflow.levels(nodes, edges).collect()} == {i: i for i in range(12)}


def test_strip_is_linear_and_knows_the_separators(spark):
    text = "\x1c \u3000a" + " " * 50_000 + "b\x1f\n"
    assert spark.createDataFrame([(text,)], "t string").select(scalar.strip(F.col("t"))).first()[0] == text.strip()


def test_ranks_and_deep_pages(spark):
    from loomline.operators.ranks import Ranked

    rows = [(i, None if i % 11 == 0 else i % 7, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, part long, at string").withColumn("rank", F.lit("old")).repartition(5)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    ranked = Ranked(df, F.desc_nulls_last("part"), "id")
    assert ranked.total == 500 and [(r.id, r.part, r.at, r["rank"]) for r in ranked.rows.orderBy("rank").collect()] == [(*r, i + 1) for i, r in enumerate(order)]
    for page, size in ((1, 10), (17, 13), (50, 10), (2, 499)):
        assert [r.id for r in ranked.page(page, size).orderBy("rank").collect()] == [r[0] for r in order[(page - 1) * size : page * size]]
    assert ranked.page(51, 10).count() == 0 and Ranked(df.limit(0), "id").page(1, 5).count() == 0
    # A page reads the ranges that it lies in.
    plan = ranked.page(1, 10)._jdf.queryExecution().sparkPlan()
    files = plan.collectLeaves().head().selectedPartitions().partitionCount()
    assert files < len(ranked.parts) or len(ranked.parts) == 1
    with pytest.raises(ValueError):
        ranked.page(0, 10)
