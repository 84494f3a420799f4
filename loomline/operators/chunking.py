"""Recursive text chunking.

A text is cut at the first separator of a ladder that it holds. Pieces shorter
than the chunk size are joined again, greedily, as long as the chunk size allows;
a longer piece goes down the rest of the ladder by itself. Chunks are stripped and
blank ones dropped. There is no overlap; lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import vector_id
from .shared import small_batches

CHUNK_SIZE = 1024
#: Fixed values, in order: blank line, line, full-width stop and comma, space, code points.
SEPARATORS = ("\n\n", "\n", "。", "，", " ", "")


def places(text: str, separator: str) -> Iterator[tuple[int, int]]:
    """Where the pieces of text.split(separator) begin and end, one at a time."""
    start = 0
    while (end := text.find(separator, start)) >= 0:
        yield start, end
        start = end + len(separator)
    yield start, len(text)


def chunked(text: str, size: int = CHUNK_SIZE, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text. A ladder that doesn't end in "" fails where nothing of it is in a long piece.

    Pieces that are joined stand beside each other in the text, so that a chunk is a slice of it and no list of words or code points is made.
    """
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        raise ValueError("no separator is left for a piece of the text")
    separator, rest = separators[at], separators[at + 1 :]
    if not separator:
        return _stripped(text[i : i + size] for i in range(0, len(text), size))
    out, start, end = [], 0, 0
    for a, b in places(text, separator):
        if b - a >= size:
            out += [*_stripped([text[start:end]]), *(chunked(text[a:b], size, rest) if rest else _stripped([text[a:b]]))]
            start = end = b
        elif start == end:
            start, end = a, b
        elif b - start <= size:
            end = b
        else:
            out += _stripped([text[start:end]])
            start, end = a, b
    return out + _stripped([text[start:end]])


def _stripped(pieces: Iterable[str]) -> list[str]:
    """Stripped, without blanks."""
    return [c for c in map(str.strip, pieces) if c]


def chunks(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Array of the chunks of a text; null has none. Marked so that no filter on the chunks makes them twice; `small_batches` of the texts keep workers small."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunked(t, size) if t else [] for t in texts], dtype=object)

    return F.pandas_udf(run, "array<string>").asNondeterministic()(text)


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """doc_id, chunk_index (from 0), content and vector_id: a row a chunk. No shuffle."""
    out = small_batches(docs).select("doc_id", chunks(F.col("text"), size).alias("chunks")).select("doc_id", F.posexplode("chunks").alias("chunk_index", "content"))
    return out.withColumn("vector_id", vector_id(F.col("doc_id"), F.col("chunk_index")))
