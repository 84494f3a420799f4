import pytest

from loomline.operators import ann, vector

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    return v, ann.CellIndex.build(v, str(tmp_path_factory.mktemp("ann") / "index"), 64)


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_recall_and_partitions_read(spark, index):
    v, at = index
    q = v.filter("vec_id % 20 = 0")
    exact = vector.top_k(v, q, k=5, threshold=0.1)
    found = at.search(q, k=5, threshold=0.1, nprobe=26)
    measured = ann.recall(found, exact).first()
    assert measured.hits >= 5 * 90 and measured.recall >= 0.9
    # One question reads its own cells and no others.
    one = at.search(q.filter("vec_id = 20"), k=5, threshold=0.1, nprobe=4)
    plan = one._jdf.queryExecution().sparkPlan()
    assert "PartitionFilters: [cell" in plan.toString()
    assert plan.collectLeaves().head().selectedPartitions().partitionCount() == 4 < len(at.at)


def test_all_probes_are_exact_for_few_and_many(index, monkeypatch):
    v, at = index
    q = v.filter("vec_id % 40 = 0")
    exact = rows(vector.top_k(v, q, k=3, threshold=0.1))
    assert rows(at.search(q, k=3, threshold=0.1, nprobe=10**6)) == exact
    some = rows(at.search(q, k=3, threshold=0.1, nprobe=6))
    monkeypatch.setattr(ann, "QUERIES", 10)
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert rows(at.search(q, k=3, threshold=0.1, nprobe=10**6)) == exact
    assert rows(at.search(q, k=3, threshold=0.1, nprobe=6)) == some


def test_odd_vectors(spark, tmp_path):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (5, [2.0, 0.1]), (6, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    at = ann.CellIndex.build(odd, str(tmp_path / "a"), 2)
    assert at.sizes.sum() == 3
    assert {(r.query_id, r.vec_id) for r in at.search(odd, k=2, nprobe=9).collect()} == {(1, 5), (5, 1)}
    none = ann.CellIndex.build(odd.filter("vec_id > 6"), str(tmp_path / "b"), 2)
    assert none.search(odd).count() == 0 and at.search(odd.filter("vec_id > 6")).count() == 0


def test_a_query_is_sent_once_to_a_group_of_cells(spark, index, monkeypatch):
    v, at = index
    made = []
    real = ann.saved
    monkeypatch.setattr(ann, "saved", lambda df, name, *by: made.append((name, real(df, name, *by))) or made[-1][1])
    monkeypatch.setattr(ann, "QUERIES", 10)
    q = v.filter("vec_id % 20 = 0")
    exact = rows(vector.top_k(v, q, k=5, threshold=0.1))
    assert rows(at.search(q, k=5, threshold=0.1, nprobe=10**6)) == exact
    # As many rows as queries, each with its groups; a row a query and cell grew faster than the input.
    (name, asked), = made
    assert name == "probes" and asked.count() == q.count()
    assert ann._groups([3, 4, 5, 0, 30, 1], 9) == [0, 0, 1, 1, 2, 3]


def test_batches_of_vectors_are_small(spark, index):
    v, at = index
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    assert at.search(v.filter("vec_id % 20 = 0"), threshold=0.1, nprobe=4).count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    ann.small_batches(v)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_sample_is_what_has_the_least_hashes(spark):
    r = spark.range(0, 4000, 1, 8).selectExpr("id", "array(cast(id as double)) as v")
    h = [x.id for x in r.selectExpr("id", "xxhash64(id) as h").orderBy("h").limit(100).collect()]
    assert [x[0] for x in ann._least(r, 4000, 100)] == h
    # Of what each partition would send, only what may be among the least ones is sent.
    asked = []
    real = type(r).filter
    type(r).filter = lambda self, c: asked.append(real(self, c)) or asked[-1]
    try:
        ann._least(r, 4000, 100)
        same = spark.range(0, 4000).selectExpr("7L as id", "array(1.0D) as v")
        assert len(ann._least(same, 4000, 100)) == 100  # one id's hash may be left out: then all are looked at
    finally:
        type(r).filter = real
    assert 100 <= asked[0].count() <= 200


def test_cells_are_learnt_in_parts():
    import tracemalloc

    import numpy as np

    m = np.random.default_rng(1).normal(size=(20_000, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    tracemalloc.start()
    at = ann._learnt(m, 512)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at.shape == (512, 8) and most < 50_000_000  # all fits at once are 82 MB
