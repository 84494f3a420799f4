import pandas as pd
from pyspark.sql import functions as F

from loomline.llm import toxicity
from loomline.llm.common import held_out


def test_held_out_documents_by_language(spark):
    """Recall by language on documents whose labels nobody learnt; a few clean ones may be taken for toxic."""
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).filter(held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "score").toPandas()
    rows["hit"] = rows["score"] >= toxicity.THRESHOLD
    recall: pd.Series = rows[rows["toxic"] == 1].groupby("lang")["hit"].mean()
    assert rows[rows["toxic"] == 1]["hit"].mean() >= 0.9 and recall.min() >= 0.85, recall
    assert rows[rows["toxic"] == 0]["hit"].mean() <= 0.01
