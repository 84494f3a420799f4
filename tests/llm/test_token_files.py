import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import DATA
from loomline.llm import token_files as T
from loomline.llm.packing import vocabulary


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 32), st.integers(0, 70), st.integers(0, 1 << 30))
def test_packing_is_lossless_and_little_endian(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    data = T.packed(ids, bits)
    assert len(data) == -(-n // 8) * bits and (T.unpacked(data, bits, n) == ids).all()
    assert int.from_bytes(data, "little") == sum(int(x) << (i * bits) for i, x in enumerate(ids))


def test_bits_of_a_vocabulary():
    assert [T.id_bits(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        T.id_bits(0)


@pytest.mark.parametrize("end", [b"", b"\n"])
def test_random_access(end):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 17, n, dtype=np.int64).astype(np.uint32) for n in (0, 1, 5000, 64, 3, 200, 0)]
    ids = [-5, 2, 2, 7, 1 << 60, None, None]
    w = T.IdFileWriter(17, 3, 1, 64)
    for i, x in zip(ids, docs):
        w.add(i, x)
    file = T.IdFile(w.finish() + end)
    whole = np.concatenate(docs)
    assert (file.bits, file.range, file.place, file.n_ids, file.doc_ids) == (17, 3, 1, len(whole), ids)
    assert all((file.at(i) == x).all() for i, x in enumerate(docs))
    for lo, hi in ((0, 0), (0, 1), (63, 65), (64, 128), (4999, 5100), (-4, 10**9)):
        assert (file.ids(lo, hi) == whole[max(lo, 0) : hi]).all()
    assert file.find(2) == [1, 2] and file.find(3) == [] and file.find(-5) == [0]
    for broken in (b"", b"x" * 200, w.finish()[:-3]):
        with pytest.raises(ValueError):
            T.IdFile(broken)


def by_library(text):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]
    return struct.pack(f"<{len(ids)}I", *ids)


def test_files_hold_what_the_library_says(spark, make, edge_rows, tmp_path):
    # Small files, so that a range has several.
    docs = make(edge_rows).repartition(3)
    T.write_ids(docs, str(tmp_path / "ids"), block=64, file_ids=500)
    rows = T.read_ids(spark, str(tmp_path / "ids")).collect()
    rows.sort(key=lambda r: (r.file_range, r.file_place, r.nth))
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 5, 6, 7, 8, None]
    of = sorted((i is None, i or 0, by_library(t)) for i, t in edge_rows)
    assert [(r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in rows] == of
    found = T.read_documents(spark, str(tmp_path / "ids"), [5, 8, 99]).collect()
    assert sorted(r.doc_id for r in found) == [5, 5, 8] and all(struct.pack(f"<{len(r.ids)}I", *r.ids) == by_library(dict(edge_rows)[r.doc_id]) for r in found)


def test_starts_and_checksums_of_the_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in T.op12_token_files(spark, DATA).collect()}
    start = 0
    for d in docs:
        ids = by_library(d.text)
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert not got


def test_no_document(spark, make, tmp_path):
    T.write_ids(make([(1, "x")]).filter("doc_id > 1"), str(tmp_path / "ids"))
    rows = T.read_ids(spark, str(tmp_path / "ids"))
    assert rows.count() == 0
    digests = rows.select("file_range", "file_place", "nth", "doc_id", "start", F.lit(1).cast("long").alias("n_tokens"))
    assert T.placed(digests).count() == 0
