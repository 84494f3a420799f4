"""Exact nearest neighbours by cosine similarity, and retrieval with context.

Up to QUERIES queries are one block that goes to all tasks: each reads its part of
the vectors once, multiplies them batch by batch in numpy and lets k rows a query
leave, so no vector is shuffled. More queries and the vectors are dealt into
blocks; each pair of blocks is one small matrix product. What is shuffled are then
the blocks, once per block of the other side, and k rows a query and block. No
pair of rows ever becomes a row. Vectors are compared to queries of their own size
only; `of_other_size` reports the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small_batches

BLOCK = 2048
#: Queries that are sent to all tasks as they are (their number is counted first), and numbers that they may hold (32 MB).
QUERIES, NUMBERS = 2048, 4_000_000


def _blocks(df: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // size))
    return df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block")), n


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, threshold: float = 0.5, exclude_self: bool = True, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score and rank (from 1) of the k best vectors of each query with score >= threshold; ties go to the smaller id.

    Scores are rounded before they are compared. Vectors without length match nothing.
    """
    # Read once, and no more of it than one block may hold: whatever makes the queries isn't asked twice.
    few = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).limit(QUERIES + 1).toPandas()
    vectors = small_batches(vectors)
    if len(few) <= QUERIES and sum(len(x) for x in few["v"] if x is not None) <= NUMBERS:
        part = _of_few(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), few, k, threshold, exclude_self, digits)
        return _best(part, k)
    v, n_v = _blocks(vectors, key, vector, block)
    q, n_q = _blocks(queries, key, vector, block)
    # A block goes to each block of the other side; a task holds one of each.
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select(F.col("block").alias("vb"), F.col("other").cast("long").alias("qb"), "id", "v", F.lit(False).alias("is_query"))
    q = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))).select(F.col("other").cast("long").alias("vb"), F.col("block").alias("qb"), "id", "v", F.lit(True).alias("is_query"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["is_query"].to_numpy(bool)
        return _nearest(_units(pdf[~on]), _units(pdf[on]), k, threshold, exclude_self, digits)

    return _best(v.unionByName(q).groupBy("vb", "qb").applyInPandas(best, _HIT), k)


_HIT = "query_id long, vec_id long, score double"


def _units(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions: ids in order and their vectors (columns id, v) at length 1."""
    rows = rows[rows["v"].map(lambda x: x is not None and len(x) > 0)].sort_values("id")
    out = {}
    for n, part in rows.groupby(rows["v"].map(len)) if len(rows) else ():
        m = np.stack([np.asarray(x, np.float64) for x in part["v"]])
        length = np.sqrt((m * m).sum(axis=1))
        if (length > 0).any():
            out[n] = part["id"].to_numpy()[length > 0], m[length > 0] / length[length > 0, None]
    return out


def _nearest(vectors: dict, queries: dict, k: int, threshold: float, exclude_self: bool, digits: int, asked: np.ndarray | None = None) -> pd.DataFrame:
    """The k best vectors (as `_units`) of each query. asked: which vectors (columns) count for a query, if not all do; then all have one size."""
    rows: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    for n, (q_ids, q_m) in queries.items():
        ids, m = vectors.get(n, (np.empty(0, np.int64), None))
        for i in range(0, len(q_ids), 256) if len(ids) else ():
            scores = np.round(q_m[i : i + 256] @ m.T, digits)
            if asked is not None:
                scores[~asked[i : i + 256]] = -np.inf
            for qid, s in zip(q_ids[i : i + 256], scores, strict=True):
                fit = np.flatnonzero((s >= threshold) & ~((ids == qid) & exclude_self))
                fit = fit[np.argsort(-s[fit], kind="stable")][:k]
                rows["query_id"] += [qid] * len(fit)
                rows["vec_id"] += ids[fit].tolist()
                rows["score"] += s[fit].tolist()
    return pd.DataFrame(rows).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _of_few(vectors: DataFrame, queries: pd.DataFrame, k: int, threshold: float, exclude_self: bool, digits: int) -> DataFrame:
    """The k best of each query in each partition of vectors (id, v)."""
    units = _units(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            new = _nearest(_units(pdf), units, k, threshold, exclude_self, digits)
            best = new if best is None else pd.concat([best, new])
            if len(best) > 4 * k * max(1, len(queries)):
                best = best.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id").head(k)

    return vectors.mapInPandas(run, _HIT)


def _best(part: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k)


def of_other_size(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and size of the vectors that a collection of `dim` dimensions can't take (null ones have size -1)."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    return vectors.select(key, size.alias("size")).filter(F.col("size") != dim)


def with_context(hits: DataFrame, chunks: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """Hits with their chunk (a hit without one is dropped after the top k, so fewer may stay) and their document's name (null without one).

    chunks: vec_id, doc_id, chunk_index, content; documents: doc_id, doc_name, deleted. strict: deleted documents don't count.
    """
    out = hits.join(chunks, "vec_id").join(documents, "doc_id", "inner" if strict else "left")
    out = out.filter(~F.coalesce("deleted", F.lit(False))) if strict else out
    return out.select("query_id", "rank", "vec_id", "content", "score", "doc_id", "doc_name", "chunk_index")


def embed(df: DataFrame, text: str, embedder, dim: int) -> DataFrame:
    """df with `embedding` of a text column, by embedder(list of texts) -> list of vectors, called once per Arrow batch."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embedder(texts.fillna("").tolist())], dtype=object)

    return small_batches(df).withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def hashing_embedder(dim: int = 64):
    """A deterministic embedder without network: signed counts of hashed words, normalised. A word's number is that of the first 32 bits of its MD5."""

    def run(texts: list[str]) -> list[list[float]]:
        import hashlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, h % dim] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return run


def embedder_of(provider: str, embedders: dict):
    """The embedder registered for a provider (in any case of letters); a provider that isn't there is an error that names those that are."""
    found = {k.lower(): v for k, v in embedders.items()}
    if provider.lower() not in found:
        raise ValueError(f"unknown embedding provider {provider}: one of {', '.join(sorted(found))}")
    return found[provider.lower()]


def retrying(call, tries: int = 3, wait=None):
    """call with retries: any error but the last is followed by a wait of min(2 ** attempt, 5) seconds."""
    import time

    def run(*args, **kwargs):
        for attempt in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:
                if attempt == tries - 1:
                    raise
                (wait or time.sleep)(min(2**attempt, 5))

    return run


def search(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, questions: DataFrame, embedder=None, top_k_: int = 5, score_threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Retrieval for questions (query_id, question) in one knowledge base: the best chunks of each, with text and document.

    vectors: vec_id, embedding of the base (filter by its id first: tables are partitioned by it); chunks and documents as in `with_context`.
    """
    if not 1 <= top_k_ <= 50 or not 0 <= score_threshold <= 1:
        raise ValueError("top_k from 1 to 50, score_threshold from 0 to 1")
    # Written, so that each question is embedded once, however many there are.
    embedded = saved(embed(questions.select(F.col("query_id").alias("vec_id"), "question"), "question", embedder or hashing_embedder(), 64), "questions")
    hits = top_k(vectors, embedded, k=top_k_, threshold=score_threshold, exclude_self=False)
    return with_context(hits, chunks, documents, strict)
