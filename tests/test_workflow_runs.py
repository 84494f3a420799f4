from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.operators import vector, workflow

NODE, EDGE = "id string, kind string, name string, test string, value string", "src string, dst string, handle string"


def run(spark, nodes, edges, runs, **kw):
    given = spark.createDataFrame(runs, "run_id long, vars map<string,string>")
    out = workflow.executed(given, spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), **kw)
    return sorted((r.run_id, r.node, r.vars, r.steps, r.status, r.error) for r in out.collect())


def test_nested_loops_begin_anew(spark):
    nodes = [("s", "start", None, None, None), ("o", "loop", None, None, "2"), ("i", "loop", None, None, "{{n}}"), ("v", "variable", "acc", None, "{{acc}}{{n}}"), ("e", "end", None, None, None)]
    edges = [("s", "o", None), ("o", "i", "body"), ("i", "v", "body"), ("v", "i", ""), ("i", "o", "done"), ("o", "e", "done")]
    got = run(spark, nodes, edges, [(1, {"n": "3"}), (2, {"n": "0"}), (3, {"n": "many"}), (4, None)])
    assert got[0] == (1, "e", {"n": "3", "acc": "3" * 6}, 18, "success", None)
    assert got[1] == (2, "e", {"n": "0"}, 6, "success", None)
    assert got[2] == (3, "i", {"n": "many"}, 2, "failed", "not a count: many")
    assert got[3] == (4, "i", {}, 2, "failed", "not a count: ")


def test_branches_errors_and_the_step_limit(spark):
    nodes = [("s", "start", None, None, None), ("c", "condition", "x", ">", "10"), ("a", "variable", "r", None, "big"), ("b", "code", None, None, None)]
    edges = [("s", "c", None), ("c", "a", "true"), ("c", "b", "false"), ("s", "gone", None)]
    got = run(spark, nodes, edges, [(1, {"x": "11"}), (2, {"x": "9"}), (3, {})])
    assert [g for g in got if g[1] == "gone"] == [(i, "gone", v, 1, "failed", "unsupported node type: none") for i, v in ((1, {"x": "11"}), (2, {"x": "9"}), (3, {}))]
    rest = [g for g in got if g[1] != "gone"]
    assert rest[0] == (1, "a", {"x": "11", "r": "big"}, 2, "success", None)
    assert [g[3:] for g in rest[1:]] == [(2, "failed", "unsupported node type: code")] * 2
    around = run(spark, nodes[:1] + [("v", "variable", "n", None, "{{n}}.")], [("s", "v", None), ("v", "v", None)], [(1, {})], max_steps=4)
    assert around == [(1, "v", {"n": "...."}, 4, "failed", "over 4 steps")]
    assert run(spark, nodes, edges, []) == []


def test_retrieval_serves_all_runs_of_a_step(spark):
    nodes = [("s", "start", None, None, None), ("k", "knowledge", "found", None, "about {{q}}"), ("e", "end", None, None, None)]
    calls = []

    def retrieve(asked):
        calls.append(asked.count())
        return asked.filter("question <> 'about b'").select("query_id", F.upper("question").alias("context"))

    got = run(spark, nodes, [("s", "k", None), ("k", "e", None)], [(1, {"q": "a"}), (2, {"q": "b"})], retrieve=retrieve)
    assert [g[2]["found"] for g in got] == ["ABOUT A", ""] and calls == [2]
    with pytest.raises(ValueError):
        run(spark, nodes, [("s", "k", None), ("k", "e", None)], [(1, {})])


def test_a_question_is_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def embedder(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return vector.hashing_embedder()(texts)

    chunks = spark.createDataFrame([(i, i, 0, f"text of number {i}") for i in range(9)], "vec_id long, doc_id long, chunk_index int, content string")
    stored = vector.embed(chunks.select("vec_id", "content"), "content", vector.hashing_embedder(), 64).select("vec_id", "embedding")
    docs = chunks.select("doc_id", F.lit("d").alias("doc_name"), F.lit(False).alias("deleted"))
    asked = spark.createDataFrame([(i, f"number {i}") for i in range(6)], "query_id long, question string").repartition(3)
    hits = vector.search(stored, chunks, docs, asked, embedder, score_threshold=0.1)
    assert hits.count() > 0 and hits.agg(F.max("score")).first()[0] > 0
    assert sorted(Path(log).read_text().splitlines()) == [f"number {i}" for i in range(6)]


def test_embedders_and_retries():
    assert vector.embedder_of("OPENAI", {"openai": 1, "local": 2}) == 1
    with pytest.raises(ValueError, match="local, openai"):
        vector.embedder_of("x", {"openai": 1, "local": 2})
    waits, left = [], [3]

    def call(x):
        left[0] -= 1
        if left[0] > 0:
            raise OSError("short read")
        return [x]

    assert vector.retrying(call, 3, waits.append)("a") == ["a"] and waits == [1, 2]
    left[0] = 5
    with pytest.raises(OSError):
        vector.retrying(call, 3, waits.append)("a")
