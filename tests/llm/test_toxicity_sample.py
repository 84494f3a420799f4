from pyspark.sql import functions as F

from loomline.llm import toxicity


def test_equal_counts_are_rows_of_their_own(spark, make, monkeypatch):
    rows = [(i, "vile words here" if i % 10 == 0 else f"plain text w{i % 7}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    choose = toxicity.choose_voters
    monkeypatch.setattr(toxicity, "choose_voters", lambda x, y, fixed, size: seen.append((len(y), int(y.sum()))) or choose(x, y, fixed, size))
    toxicity.score(make(rows + rows[:50]), labels).count()
    sample = toxicity.labelled_sample(labels)
    assert seen == 2 * [(sample.count(), sample.filter(F.col("toxic") == 1).count())]


def test_unrelated_words_of_equal_counts_all_stay(spark, make):
    words = ["vile", "rottenish", "foulest"]
    rows = [(i, " ".join(words) if i % 10 == 0 else f"plain text w{i % 7}") for i in range(300)]
    sample = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "l_id long, toxic int")
    assert sorted(toxicity.induce(make(rows), sample)) == sorted(words)  # and none of their prefixes
