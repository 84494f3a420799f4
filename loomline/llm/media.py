"""Media columns: ISO media containers, read without decoding what they hold.

`probe` walks the nested boxes of a binary column, decodes each track's sample
tables (durations, sizes, chunk runs, chunk offsets, sync samples; also the runs
of movie fragments) and returns codec, duration and the byte ranges of the key
frames. Ranges come from table arithmetic alone: no payload byte is looked at.
`store_texts` writes such files: a text's bytes, padded with zeros to a multiple
of 64, as frames of 8 by 8 samples of 8 bits, uncompressed.

Everything works row by row inside Arrow batches: no shuffle, nothing gathered.

Defined results: null and empty media have no tracks and the error "no bytes";
malformed boxes or tables give what was read until then and say why in `error`,
and no table makes more samples than its file has bytes;
null text is stored like empty text (one frame of zeros); repeated rows repeat;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, unused

#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = frozenset(b"moov trak mdia minf stbl dinf edts udta mvex moof traf".split())
FRAME, FRAMES_PER_CHUNK, TIMESCALE = 64, 16, 25

TRACKS = "array<struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,duration_s:double,n_samples:long,width:int,height:int,keyframes:array<struct<offset:long,size:long>>>>"


class Malformed(ValueError):
    """A box or table that its file can't hold."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first payload byte and end of each box in a range."""
    while start < end:
        if end - start < 8:
            raise Malformed(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise Malformed(f"no room for a large size at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or start + size > end:
            raise Malformed(f"box {kind.decode('latin-1')!r} at {start} has {size} bytes")
        yield kind, start + head, start + size
        start += size


def walk(data: memoryview, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """All boxes, outer before inner; a path names the types above, with the position of each container."""
    for kind, a, b in boxes(data, start, end):
        yield (*path, (kind, a)), a, b
        if kind in CONTAINERS and len(path) < 16:
            yield from walk(data, a, b, (*path, (kind, a)))


def _array(data: memoryview, a: int, b: int, dtype: str, n: int, width: int = 1) -> np.ndarray:
    if n * width * np.dtype(dtype).itemsize > b - a:
        raise Malformed(f"a table at {a} is cut short")
    return np.frombuffer(data, dtype, n * width, a).astype(np.int64).reshape((n, width) if width > 1 else n)


def _u32(data: memoryview, a: int, b: int) -> int:
    if a + 4 > b:
        raise Malformed(f"a field at {a} is cut short")
    return struct.unpack_from(">I", data, a)[0]


class Track:
    """Sample tables of one track as they are read."""

    def __init__(self):
        self.id, self.handler, self.codec, self.timescale, self.duration, self.width, self.height = 0, "", "", 0, 0, 0, 0
        self.sizes = self.chunk_runs = self.chunk_at = self.sync = None
        self.times = 0
        self.moved: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []  # of fragments: offsets, sizes, sync, duration

    def read(self, kind: bytes, data: memoryview, a: int, b: int) -> None:
        wide = data[a] == 1 if b > a else False
        if kind == b"tkhd":
            self.id = _u32(data, a + (20 if wide else 12), b)
            self.width, self.height = _u32(data, b - 8, b) >> 16, _u32(data, b - 4, b) >> 16
        elif kind == b"mdhd":
            self.timescale = _u32(data, a + (20 if wide else 12), b)
            self.duration = _u32(data, a + 24, b) << 32 | _u32(data, a + 28, b) if wide else _u32(data, a + 16, b)
        elif kind == b"hdlr":
            self.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            if _u32(data, a + 4, b):
                self.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            runs = _array(data, a + 8, b, ">u4", _u32(data, a + 4, b), 2)
            self.times = int((runs[:, 0] * runs[:, 1]).sum()) if len(runs) else 0
        elif kind == b"stss":
            self.sync = _array(data, a + 8, b, ">u4", _u32(data, a + 4, b)) - 1
        elif kind == b"stsc":
            self.chunk_runs = _array(data, a + 8, b, ">u4", _u32(data, a + 4, b), 3).reshape(-1, 3)
        elif kind == b"stsz":
            each, n = _u32(data, a + 4, b), _u32(data, a + 8, b)
            if each and each * n > len(data):
                raise Malformed(f"{n} samples of {each} bytes in a file of {len(data)}")
            self.sizes = np.full(n, each, np.int64) if each else _array(data, a + 12, b, ">u4", n)
        elif kind == b"stz2":
            bits, n = _u32(data, a + 4, b) & 255, _u32(data, a + 8, b)
            if bits == 4:
                pairs = _array(data, a + 12, b, "u1", (n + 1) // 2)
                self.sizes = np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
            else:
                self.sizes = _array(data, a + 12, b, "u1" if bits == 8 else ">u2", n)
        elif kind in (b"stco", b"co64"):
            self.chunk_at = _array(data, a + 8, b, ">u4" if kind == b"stco" else ">u8", _u32(data, a + 4, b))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, size and whether it is a key frame, of each sample."""
        sizes = self.sizes if self.sizes is not None else np.empty(0, np.int64)
        n, at = len(sizes), self.chunk_at if self.chunk_at is not None else np.empty(0, np.int64)
        key = np.ones(n, bool)
        if self.sync is not None:
            key = np.zeros(n, bool)
            key[self.sync[(self.sync >= 0) & (self.sync < n)]] = True
        offsets = np.empty(0, np.int64)
        if n:
            runs = self.chunk_runs
            if runs is None or not len(runs) or not len(at):
                raise Malformed("samples without chunks")
            spans = np.diff(np.append(runs[:, 0] - 1, len(at)))
            if runs[0, 0] != 1 or (spans < 0).any():
                raise Malformed("chunk runs out of order")
            per_chunk = np.repeat(runs[:, 1], spans)
            if per_chunk.sum() < n:
                raise Malformed(f"chunks hold {per_chunk.sum()} of {n} samples")
            first = np.concatenate([[0], np.cumsum(per_chunk)])
            chunk = np.searchsorted(first, np.arange(n), side="right") - 1
            before = np.concatenate([[0], np.cumsum(sizes)])
            offsets = at[chunk] + before[:n] - before[np.minimum(first[chunk], n)]
        parts = [(offsets, sizes, key), *[m[:3] for m in self.moved]]
        return tuple(np.concatenate(x) for x in zip(*parts))


def _fragment(track: Track, data: memoryview, moof: int, base: dict, kind: bytes, a: int, b: int) -> None:
    """Movie fragments: samples from trun, defaults from tfhd, and what tfhd leaves out from trex (in base already)."""
    flags = _u32(data, a, b) & 0xFFFFFF
    at = a + (8 if kind == b"tfhd" else 4)
    if kind == b"tfhd":
        base.setdefault("at", moof)
        for bit, name, width in ((1, "at", 8), (2, "", 4), (8, "duration", 4), (16, "size", 4), (32, "flags", 4)):
            if flags & bit:
                value = _u32(data, at, b) << 32 | _u32(data, at + 4, b) if width == 8 else _u32(data, at, b)
                base[name] = value
                at += width
        return
    n = _u32(data, at, b)
    at += 4
    start = base.get("next", base.get("at", moof))
    if flags & 1:
        start = base.get("at", moof) + struct.unpack_from(">i", data, at)[0]
        at += 4
    first_flags = None
    if flags & 4:
        first_flags = _u32(data, at, b)
        at += 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    table = _array(data, at, b, ">u4", n, len(fields)).reshape(n, len(fields)) if fields else np.empty((n, 0), np.int64)
    column = {f: table[:, i] for i, f in enumerate(fields)}
    each = base.get("size", 0)
    if 0x200 not in column and n and (not each or each * n > len(data)):
        raise Malformed(f"{n} samples of {each} bytes in a file of {len(data)}")
    sizes = column[0x200] if 0x200 in column else np.full(n, each, np.int64)
    marks = column[0x400].copy() if 0x400 in column else np.full(n, base.get("flags", 0), np.int64)
    if first_flags is not None and n:
        marks[0] = first_flags
    ends = np.cumsum(sizes)
    track.moved.append((start + ends - sizes, sizes, (marks & 0x10000) == 0, int(column[0x100].sum()) if 0x100 in column else n * base.get("duration", 0)))
    base["next"] = start + int(ends[-1]) if n else start


def read_tracks(media: bytes | None) -> tuple[list[Track], str | None]:
    """The tracks of a file, and what stopped the reading, if anything did."""
    if not media:
        return [], "no bytes"
    data, tracks, error = memoryview(media), {}, None
    ids: dict[int, Track] = {}
    defaults: dict[int, dict] = {}
    moved: dict[int, tuple[Track, dict]] = {}
    try:
        for path, a, b in walk(data, 0, len(data)):
            kind = path[-1][0]
            if trak := next((p for p in path if p[0] == b"trak"), None):
                track = tracks.setdefault(trak[1], Track())
                track.read(kind, data, a, b)
                if kind == b"tkhd":
                    ids[track.id] = track
            elif kind == b"trex":
                defaults[_u32(data, a + 4, b)] = dict(zip(("duration", "size", "flags"), (_u32(data, a + at, b) for at in (12, 16, 20))))
            elif kind in (b"tfhd", b"trun") and (traf := next((p for p in path if p[0] == b"traf"), None)):
                if kind == b"tfhd":
                    of = _u32(data, a + 4, b)
                    moved[traf[1]] = ids.setdefault(of, Track()), dict(defaults.get(of, {}))
                if traf[1] in moved:
                    moof = next((p[1] - 8 for p in path if p[0] == b"moof"), 0)
                    _fragment(moved[traf[1]][0], data, moof, moved[traf[1]][1], kind, a, b)
    except (Malformed, struct.error) as e:
        error = str(e)
    return [*tracks.values()], error


def probed(media: bytes | None) -> tuple[list[dict], str | None]:
    """Tracks as `probe` returns them."""
    tracks, error = read_tracks(media)
    out = []
    for t in tracks:
        try:
            offsets, sizes, key = t.samples()
        except Malformed as e:
            error, (offsets, sizes, key) = error or str(e), (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)
        duration = t.times or t.duration
        duration += sum(m[3] for m in t.moved)
        out.append({
            "track_id": t.id, "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": duration, "duration_s": duration / t.timescale if t.timescale else None,
            "n_samples": len(sizes), "width": t.width, "height": t.height, "keyframes": [{"offset": o, "size": s} for o, s in zip(offsets[key].tolist(), sizes[key].tolist())],
        })
    return out, error


def probe(df: DataFrame, media: str = "media") -> DataFrame:
    """df with columns `tracks` and `error` of the containers in a binary column (replacing columns of these names)."""

    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"tracks": t, "error": e} for t, e in map(probed, files)], columns=["tracks", "error"])

    (at,) = unused(df, "probed")
    out = df.withColumn(at, F.pandas_udf(run, f"tracks {TRACKS}, error string")(F.col(media)))
    return out.withColumns({"tracks": F.col(f"{at}.tracks"), "error": F.col(f"{at}.error")}).drop(at)


def samples_of(media: bytes) -> bytes:
    """The bytes of all samples of the first track, in order, taken from the places that its tables name."""
    tracks, error = read_tracks(media)
    if error or not tracks:
        raise Malformed(error or "no track")
    offsets, sizes, _ = tracks[0].samples()
    if len(offsets) and offsets.max() + sizes[offsets.argmax()] > len(media):
        raise Malformed("samples lie outside the file")
    return b"".join(media[o : o + s] for o, s in zip(offsets.tolist(), sizes.tolist()))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def muxed(payload: bytes) -> bytes:
    """An ISO media file with a payload (of whole frames) as uncompressed 8 by 8 video; a chunk's first frame is a key frame. Equal payloads give equal files."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    rest = n - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1), (chunks, rest, 1)] if rest < FRAMES_PER_CHUNK and chunks > 1 else [(1, rest if chunks == 1 else FRAMES_PER_CHUNK, 1)]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))

    def moov(data_at: int) -> bytes:
        at = data_at + np.arange(chunks, dtype=np.int64) * FRAME * FRAMES_PER_CHUNK
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * FRAMES_PER_CHUNK).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes()),
        )
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    mdat = _box(b"mdat", payload)
    before = len(ftyp) + len(moov(0)) + len(mdat) - len(payload)
    return ftyp + moov(before) + mdat


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of the frame, and their number without these."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % FRAME if raw else FRAME), len(raw)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):  # smaller batches on the way on: they hold whole files
            part = batch.slice(at, 500)
            payloads = [payload_of(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array([muxed(p) for p, _ in payloads], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as an ISO media file."""
    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def feature(tracks: list[dict], error: str | None) -> str:
    """codec, time scale, duration, frames, key frames and a digest of their byte ranges, of what `probed` returns."""
    if error:
        return f"error={error}"
    t = tracks[0]
    ranges = ",".join(f"{k['offset']}+{k['size']}" for k in t["keyframes"])
    return f"codec={t['codec'].strip()};size={t['width']}x{t['height']};timescale={t['timescale']};duration={t['duration']};samples={t['n_samples']};keyframes={len(t['keyframes'])};ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,size:long>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
    for batch in batches:
        rows = []
        for m in batch.column(2):
            media = m.as_py()
            payload, (tracks, error) = samples_of(media), probed(media)
            t = tracks[0]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(tracks, error), t["codec"].strip(), t["duration_s"], t["keyframes"]))
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, kinds)], names=["doc_id", "n_bytes", *names])


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of what stored media hold, read through their sample tables, with `feature`, codec, duration and the byte ranges of the key frames."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, _DIGESTS)


def store_and_read(docs: DataFrame) -> DataFrame:
    """read_back(store_texts(docs)) in one Python worker, so that files needn't pass through the JVM in between."""
    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _read(_stored(batches)), _DIGESTS)


def op1_media(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
