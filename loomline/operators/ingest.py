"""Document ingestion: parse, chunk, embed, with a status for each document.

One plan without a shuffle: a document that fails is a row with a message, and
the others go on. Chunks and vectors carry deterministic ids, so a task or a
batch that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import known_model, strip, vector_id, vector_size
from .chunking import CHUNK_SIZE, chunks
from .shared import small_batches
from .vector import embed, hashing_embedder

#: The states of a document, in order.
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"


def processed(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """docs (doc_id, text, error) with chunks, status, error_message and chunk_count."""
    text = F.when(F.col("error").isNull(), F.col("text"))
    out = small_batches(docs).withColumn("chunks", chunks(text, size))
    blank = F.coalesce(~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(blank, F.lit("document is empty")).when(F.size("chunks") == 0, F.lit("no chunks"))
    out = out.withColumn("error_message", message).withColumn("status", F.when(message.isNull(), COMPLETED).otherwise(FAILED))
    return out.withColumn("chunk_count", F.when(F.col("status") == COMPLETED, F.size("chunks")).otherwise(0))


def vectors(processed_docs: DataFrame, embedder=None, dim: int = 64) -> DataFrame:
    """doc_id, chunk_index, content, vector_id and embedding of the chunks of completed documents."""
    rows = processed_docs.filter(F.col("status") == COMPLETED).select("doc_id", F.posexplode("chunks").alias("chunk_index", "content"))
    return embed(rows.withColumn("vector_id", vector_id(F.col("doc_id"), F.col("chunk_index"))), "content", embedder or hashing_embedder(dim), dim)


def verified(processed_docs: DataFrame, stored: DataFrame) -> DataFrame:
    """processed_docs, those failed whose stored vectors (doc_id) aren't as many as their chunks."""
    n = stored.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("_n"))
    out = processed_docs.join(n, F.col("doc_id") == F.col("_doc"), "left")
    short = (F.col("status") == COMPLETED) & (F.coalesce("_n", F.lit(0)) != F.col("chunk_count"))
    message = F.concat(F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" vectors for "), F.col("chunk_count").cast("string"), F.lit(" chunks"))
    changed = {"error_message": F.when(short, message).otherwise(F.col("error_message")), "status": F.when(short, FAILED).otherwise(F.col("status")), "chunk_count": F.when(short, 0).otherwise(F.col("chunk_count"))}
    return out.withColumns(changed).drop("_doc", "_n")


def states(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """doc_id, step (from 1), status and error_message: every state that a document goes through, in order."""
    done = processed(docs, size).select("doc_id", "status", "error_message")
    step = lambda s, message: F.struct(s.alias("status"), message.alias("error_message"))
    none = F.lit(None).cast("string")
    path = F.array(step(F.lit(PENDING), none), step(F.lit(PROCESSING), none), step(F.col("status"), F.col("error_message")))
    return done.select("doc_id", F.posexplode(path).alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("step"), "s.*")


def new_bases(requests: DataFrame, default_model: str = "BAAI/bge-m3") -> DataFrame:
    """Rows of knowledge bases to create from requests (id, tenant_id, name, description, embedding_model): with the trimmed name, counters at 0, the base's collection and its vector size; error instead for a blank name or a model whose size isn't known."""
    model = F.coalesce("embedding_model", F.lit(default_model))
    name = strip(F.coalesce("name", F.lit("")))
    error = F.when(name == "", "name is empty").when(~known_model(model), F.concat(F.lit("unknown embedding model: "), model))
    rows = requests.select("id", "tenant_id", name.alias("name"), "description", model.alias("embedding_model"), error.alias("error"))
    made = F.col("error").isNull()
    return rows.select("*", F.lit(0).alias("document_count"), F.lit(0).cast("long").alias("chunk_count"), F.when(made, F.concat(F.lit("kb_"), F.col("id").cast("string"))).alias("collection"), F.when(made, vector_size(F.col("embedding_model"))).alias("size"))
