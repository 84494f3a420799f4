import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(data):
    payload = data + bytes(-len(data) % 64 if data else 64)
    file = M.muxed(payload)
    assert M.samples_of(file) == payload
    (track,), error = M.probed(file)
    n = len(payload) // 64
    assert error is None and track["codec"] == "raw " and track["duration"] == track["n_samples"] == n and track["duration_s"] == n / 25
    assert [file[k["offset"] : k["offset"] + k["size"]] for k in track["keyframes"]] == [payload[i : i + 64] for i in range(0, len(payload), 64 * 16)]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_broken_files_give_errors(data):
    file = bytearray(M.muxed(bytes(64 * 40)))
    for _ in range(data.draw(st.integers(1, 6))):
        file[data.draw(st.integers(0, 700))] = data.draw(st.integers(0, 255))
    cut = data.draw(st.integers(0, len(file)))
    M.probed(bytes(file))
    M.probed(bytes(file[:cut]))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_sizes_chunks_and_fragments():
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stss", struct.pack(">II", 1, 3)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 7, 11)), full(b"stco", struct.pack(">III", 2, 1000, 2000)))
    mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 25))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 25), bytes(52), struct.pack(">II", 640 << 16, 480 << 16)), box(b"mdia", mdhd, box(b"minf", stbl)))
    (t,), error = M.probed(box(b"moov", trak))
    assert error is None and (t["codec"], t["duration"], t["timescale"], t["n_samples"], t["width"], t["height"], t["track_id"]) == ("avc1", 25, 100, 3, 640, 480, 9)
    assert t["keyframes"] == [{"offset": 2000, "size": 11}]
    tfhd = box(b"tfhd", struct.pack(">II", 0x020000, 9))
    trun = box(b"trun", struct.pack(">IIi", 0x000301, 2, 80), struct.pack(">IIII", 3, 10, 4, 20))
    moov = box(b"moov", trak)
    (t,), error = M.probed(moov + box(b"moof", box(b"traf", tfhd, trun)))
    assert error is None and t["n_samples"] == 5 and t["duration"] == 32
    assert t["keyframes"][1:] == [{"offset": len(moov) + 80, "size": 10}, {"offset": len(moov) + 90, "size": 20}]


def test_fragment_defaults_and_counts_beyond_the_file():
    import tracemalloc

    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 25), bytes(60)), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 0))))
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">IIIII", 9, 1, 4, 6, 0x10000))))
    tfhd = box(b"tfhd", struct.pack(">II", 0x020000, 9))
    fragment = box(b"moof", box(b"traf", tfhd, box(b"trun", struct.pack(">IIiI", 0x5, 3, 100, 0)))) + bytes(40)
    (t,), error = M.probed(moov + fragment)  # first sample a key frame, sizes and durations of trex
    assert error is None and t["n_samples"] == 3 and t["duration"] == 12 and t["keyframes"] == [{"offset": len(moov) + 100, "size": 6}]
    for trex in (moov, box(b"moov", trak)):
        tracemalloc.start()
        _, error = M.probed(trex + box(b"moof", box(b"traf", tfhd, box(b"trun", struct.pack(">II", 0, 30_000_000)))))
        assert "30000000 samples" in error and tracemalloc.get_traced_memory()[1] < 1e6
        tracemalloc.stop()


def test_probe_and_query(spark, make, edge_rows):
    docs = make(edge_rows)
    out = M.store_and_read(docs).collect()
    assert len(out) == len(edge_rows)
    want = {(i, hashlib.sha256(M.payload_of(t)[0]).hexdigest(), zlib.crc32(M.payload_of(t)[0][-64:])) for i, t in edge_rows}
    assert {(r.doc_id, r.payload_sha256, r.tail_crc32) for r in out} == want
    assert all(r.codec == "raw" and r.duration_s == r.payload_bytes / 64 / 25 and len(r.keyframes) == -(-r.payload_bytes // 1024) and {k.size for k in r.keyframes} == {64} for r in out)
    assert sorted(M.read_back(M.store_texts(docs)).collect(), key=str) == sorted(out, key=str)
    rows = M.probe(M.store_texts(docs)).select("error", "tracks").collect()
    assert all(r.error is None and r.tracks[0].codec == "raw " for r in rows)
    bad = spark.createDataFrame([(None,), (b"",), (b"nonsense here",)], "media binary")
    assert all(r.error and r.tracks == [] for r in M.probe(bad).collect())
    assert M.store_and_read(docs.limit(0)).count() == 0
