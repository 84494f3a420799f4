"""Packing: documents into sequences of a fixed number of tokens, by best-fit decreasing.

Documents longer than a window are first cut into full windows. Pieces, which
carry lengths and a checksum but no ids, are numbered where they are written and
dealt by the hash of that number (so that equal rows part) into shards of about
shard_pieces, and each shard is packed by itself: longest first, each piece into
the open sequence with the least room that still takes it. A segment tree over
the amounts of room from 0 to the window finds that sequence in log2(window)
steps. The number of shards follows the number of pieces, so a shard never
outgrows a task, and the waste of one not full sequence a shard is negligible.

Defined results: null or empty text is the end id alone; every row of documents
is packed, also those that repeat a doc_id or have none; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .words import word_ids, words

WINDOW, SHARD_PIECES, END_ID = 2048, 16_384, 1

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a text, little-endian unsigned 32-bit, with the end id."""
    return b"".join(map(word_ids(path).__getitem__, words(text or ""))) + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer_name: str = "word_bpe_49k.json", window: int = WINDOW) -> DataFrame:
    """Full windows of each document and what is left of it: a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        path = vocabulary(tokenizer_name)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_bytes(text.as_py(), path)
                n = len(ids) // 4
                rows += [(doc_id, i, min(window, n - i), zlib.crc32(ids[4 * i : 4 * (i + window)]), n) for i in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


class Room:
    """Open sequences by the room they have: a segment tree over 0..window."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.some = [False] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        i = room + self.base
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least `need` that an open sequence has, or -1."""
        i = need + self.base
        if self.some[i]:
            return need
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i + (not self.some[2 * i])
                return i - self.base
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        sequence = self.open[room].pop()
        i = room + self.base
        if not self.open[room]:
            self.some[i] = False
            while (i := i >> 1) and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
        return sequence


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """The sequence and the offset in it of each piece; lengths come longest first."""
    room, sequences, offsets, n = Room(window), [], [], 0
    for length in lengths:
        if (left := room.tightest(length)) < 0:
            left, sequence, n = window, n, n + 1
        else:
            sequence = room.take(left)
        sequences.append(sequence)
        offsets.append(window - left)
        if left > length:
            room.add(sequence, left - length)
    return sequences, offsets


def pack(docs: DataFrame, tokenizer_name: str = "word_bpe_49k.json", window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row a piece of documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer_name, window), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        sequences, offsets = best_fit_decreasing(pdf["length"].tolist(), window)
        shard = int(pdf["shard"].iloc[0])
        return pdf.assign(sequence_id=[(shard << 32) + s for s in sequences], offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(packed, _PIECES + ", sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
