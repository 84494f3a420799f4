"""Functions for SQL text: cosine_score, template_variables, chunk_vector_id, and the table function chunk_text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import CHUNK_SIZE, chunked

_COSINE = """
create or replace temporary function cosine_score(a array<float>, b array<float>) returns double return
  aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)
  / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + cast(v as double) * cast(v as double))) * sqrt(aggregate(b, 0D, (s, v) -> s + cast(v as double) * cast(v as double))), 0D)
"""
_VARIABLES = r"create or replace temporary function template_variables(content string) returns array<string> return array_distinct(regexp_extract_all(content, '(?U)\\{\\{(\\w+)\\}\\}', 1))"


class _ChunkText:
    def eval(self, text: str):
        yield from enumerate(chunked(text, CHUNK_SIZE) if text else [])


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    spark.sql(_COSINE)
    spark.sql(_VARIABLES)
    spark.udtf.register("chunk_text", udtf(_ChunkText, returnType="chunk_index int, content string"))
