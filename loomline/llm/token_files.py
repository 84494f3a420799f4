"""Token ids in files: fixed-width bit packing, with block offsets for random access.

Every id takes the bits that the largest id of the vocabulary needs. Eight ids fill
a whole number of bytes, so numpy packs and unpacks them lane by lane (the k-th of
each eight at once), and a block of BLOCK ids begins at a byte that the file names.

Documents are dealt to ranges of doc_id and sorted within; each range is encoded,
packed and written as it streams by, in files of about FILE_IDS ids, which Spark's
own writer commits: a task that is run again leaves no second copy. A file is one
record of that writer, which puts a line feed behind it.

A file, little-endian: the header (magic, version, bits, ids a block, ids,
documents, range, place in the range), the blocks, the place of each block and of
their end, the document ids, where each document begins and the last ends, a bit
for each document without an id, the footer (places of the two tables, magic).

Defined results: null and empty text is the end id alone; documents are in
ascending order of doc_id, those without one last; rows that repeat a doc_id are
documents of their own, in the order of their texts' hashes; a document lies in
one file, however long; an empty table gives no document; other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, shared_dir, texts, written
from .packing import token_bytes, vocabulary
from .words import tokenizer

#: Ids to a block (a multiple of eight) and to a file.
BLOCK, FILE_IDS = 4096, 1 << 23
TOKENIZER = "word_bpe_49k.json"

_MAGIC, _VERSION = b"LOOMIDS\n", 1
_HEADER = struct.Struct("<8sIIIQQQQ")
_FOOTER = struct.Struct("<QQ8s")


def packed(ids: np.ndarray, bits: int) -> bytes:
    """ids at `bits` bits each; the last byte group is filled with zeros up to eight ids."""
    if bits % 8 == 0:
        whole = np.zeros((-(-len(ids) // 8) * 8, 4), np.uint8)
        whole[: len(ids)] = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return whole[:, : bits // 8].tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for k in range(8):
        low = k * bits
        value = lanes[:, k] << np.uint64(low % 8)
        for b in range(low // 8, (low + bits - 1) // 8 + 1):
            out[:, b] |= (value >> np.uint64(8 * (b - low // 8))).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits % 8 == 0:
        whole = np.zeros((n, 4), np.uint8)
        whole[:, : bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, bits // 8)
        return whole.reshape(-1).view("<u4").astype(np.uint32, copy=False)
    rows = np.frombuffer(data, np.uint8, -(-n // 8) * bits).reshape(-1, bits)
    out = np.empty((len(rows), 8), np.uint32)
    for k in range(8):
        low = k * bits
        value = np.zeros(len(rows), np.uint64)
        for b in range(low // 8, (low + bits - 1) // 8 + 1):
            value |= rows[:, b].astype(np.uint64) << np.uint64(8 * (b - low // 8))
        out[:, k] = (value >> np.uint64(low % 8)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def id_bits(vocabulary_size: int) -> int:
    """Bits that the ids 0 to vocabulary_size - 1 need: 1 to 32."""
    if not 1 <= vocabulary_size <= 1 << 32:
        raise ValueError("a vocabulary has from 1 to 2**32 ids")
    return max(1, (vocabulary_size - 1).bit_length())


class IdFileWriter:
    """Gathers documents and packs whole blocks as they fill."""

    def __init__(self, bits: int, range_: int = 0, place: int = 0, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block has a multiple of eight ids")
        self.bits, self.range, self.place, self.block = bits, range_, place, block
        self.done: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.n_open = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.starts = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= 16 * self.block:
            ids = np.concatenate(self.open)
            whole = len(ids) - len(ids) % self.block
            self.done.append(packed(ids[:whole], self.bits))
            self.open, self.n_open = [ids[whole:].copy()], len(ids) - whole

    def finish(self) -> bytes:
        if self.n_open:
            self.done.append(packed(np.concatenate(self.open), self.bits))
        body = b"".join(self.done)
        blocks = np.append(np.arange(0, len(body), self.block * self.bits // 8), len(body)).astype("<u8") + _HEADER.size
        none = np.array([d is None for d in self.doc_ids], bool)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        docs = ids.tobytes() + np.array(self.starts, "<u8").tobytes() + np.packbits(none).tobytes()
        at = _HEADER.size + len(body)
        header = _HEADER.pack(_MAGIC, _VERSION, self.bits, self.block, self.n_ids, len(ids), self.range, self.place)
        return b"".join([header, body, blocks.tobytes(), docs, _FOOTER.pack(at, at + blocks.nbytes, _MAGIC)])


class IdFile:
    """A file's ids by place, and its documents. data: its bytes, or a memory map of it."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        end = len(self.data) - (self.data[-len(_MAGIC) :] != _MAGIC)  # without the writer's line feed
        if end < _HEADER.size + _FOOTER.size or self.data[:8] != _MAGIC or self.data[end - 8 : end] != _MAGIC:
            raise ValueError("not a file of token ids, or one cut short")
        _, version, self.bits, self.block, self.n_ids, n, self.range, self.place = _HEADER.unpack_from(self.data)
        at_blocks, at_docs, _ = _FOOTER.unpack_from(self.data, end - _FOOTER.size)
        if version != _VERSION:
            raise ValueError(f"version {version} of the format isn't known")
        self.blocks = np.frombuffer(self.data, "<u8", (at_docs - at_blocks) // 8, at_blocks)
        ids = np.frombuffer(self.data, "<i8", n, at_docs)
        self.starts = np.frombuffer(self.data, "<u8", n + 1, at_docs + 8 * n).astype(np.int64)
        none = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-n // 8), at_docs + 16 * n + 8), count=n).astype(bool)
        self.n_docs, self.known = n, ids[~none]  # those without an id come last
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, none)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start <= place < stop, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        base = first * self.block
        n = min((last + 1) * self.block, self.n_ids) - base
        return unpacked(self.data[int(self.blocks[first]) : int(self.blocks[last + 1])], self.bits, n)[start - base : stop - base]

    def at(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def find(self, doc_id: int) -> list[int]:
        """Which documents of the file have this id."""
        return list(range(int(np.searchsorted(self.known, doc_id, "left")), int(np.searchsorted(self.known, doc_id, "right"))))


def write_ids(docs: DataFrame, path: str, tokenizer_name: str = TOKENIZER, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of rows (doc_id, text), each document with its end id, as files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where = vocabulary(tokenizer_name)
        bits, range_, place = id_bits(tokenizer(where).get_vocab_size(with_added_tokens=True)), TaskContext.get().partitionId(), 0
        told = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], names=["file"])
        file = IdFileWriter(bits, range_, place, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                file.add(doc_id, np.frombuffer(token_bytes(text.as_py(), where), "<u4"))
                if file.n_ids >= file_ids:
                    yield told(file)
                    place += 1
                    file = IdFileWriter(bits, range_, place, block)
        if file.n_ids:
            yield told(file)

    # Where a row was read parts equal rows, so that ranges can cut between them.
    order = [F.asc_nulls_last("doc_id"), F.col("row_key"), F.col("read")]
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"), F.monotonically_increasing_id().alias("read"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    # Spark's text writer puts out the bytes of a string as they are.
    dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _read(spark: SparkSession, path: str, names: list[str], types: str, told) -> DataFrame:
    """Of each document in the files under path: file_range, file_place, nth (in its file), doc_id, start (ids of its file before it), and what `told` says of its ids (little-endian, four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for batch in batches for x in batch.column(0) if len(x.as_buffer())):
            file = IdFile(data.as_buffer())
            for first in range(0, file.n_docs, 256):
                last = min(first + 256, file.n_docs)
                lo, n, starts = int(file.starts[first]), last - first, file.starts[first : last + 1]
                ids = memoryview(file.ids(lo, int(file.starts[last])).astype("<u4", copy=False)).cast("B")
                own = [told(ids[4 * (a - lo) : 4 * (b - lo)]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
                columns = [pa.array([file.range] * n, pa.int64()), pa.array([file.place] * n, pa.int64()), pa.array(range(first, last), pa.int64()), pa.array(file.doc_ids[first:last], pa.int64()), pa.array(starts[:-1])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in zip(*own))], names=["file_range", "file_place", "nth", "doc_id", "start", *names])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"file_range long, file_place long, nth long, doc_id long, start long, {types}")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """file_range, file_place, nth (in its file), doc_id, start (ids of its file before it) and ids (little-endian, four bytes each) of each document in the files under path."""
    return _read(spark, path, ["ids"], "ids binary", lambda ids: (bytes(ids),))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with n_tokens and ids_crc32 in place of ids."""
    return _read(spark, path, ["n_tokens", "ids_crc32"], "n_tokens long, ids_crc32 long", lambda ids: (len(ids) // 4, zlib.crc32(ids)))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of a few documents: of each file only the blocks that hold them are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (x for batch in batches for x in batch.column(0) if len(x.as_buffer())):
            file = IdFile(data.as_buffer())
            found = [(d, file.at(i).astype(np.int64)) for d in doc_ids for i in file.find(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<long>")


def placed(rows: DataFrame) -> DataFrame:
    """rows (file_range, file_place, start, n_tokens, ...), small and written, with start among all ids in place of start in the file."""
    spark = rows.sparkSession
    sizes = sorted(tuple(r) for r in rows.groupBy("file_range", "file_place").agg(F.sum("n_tokens")).collect())  # a row a file
    before = [0, *accumulate(n for *_, n in sizes)]
    known = spark.createDataFrame([(a, b, n) for (a, b, _), n in zip(sizes, before)], "file_range long, file_place long, before long")
    return rows.join(F.broadcast(known), ["file_range", "file_place"]).withColumn("start", F.col("start") + F.col("before")).drop("file_range", "file_place", "nth", "before")


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/loomline/token-files-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return placed(written(read_digests(spark, path), "token-digests"))
