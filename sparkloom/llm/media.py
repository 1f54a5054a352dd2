"""ISO base media files as a column: write one, walk its boxes, decode its sample tables, read the samples back.

write_media() stores bytes as uncompressed 8-bit grey frames of 16 x 12 pixels (192 bytes a frame). read_tables() looks
only at box headers and tables: codec, size, duration, and the byte ranges of keyframes and of chunks; payload bytes are
copied by read_samples() alone, from those ranges.

Of a file with several tracks the first video track is read, or else the first track; tables are only ever taken from that
track's own boxes. Boxes are walked with an explicit stack, and every count in a table is held against the bytes of its
box or of the file before anything is allocated.

Defined results: a null or empty text is padded to one frame of spaces; a null or broken file (cut boxes or tables, tables
that disagree, samples outside the file) has null fields and the reason in ``error``, and never fails a task; equal payloads give equal files, so repeated rows do, and
an empty table gives an empty result; texts of any length are stored whole; other columns are carried along, and columns named as an output
are replaced.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import map_columns

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
TIMESCALE = 24
KEY_EVERY = 24  # a sync sample each second
CHUNK_FRAMES = 64
DEEPEST = 32  # levels of nested boxes; a file has seven
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"))

_TABLES = "codec string, width int, height int, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start:bigint,length:bigint>>, chunks array<struct<start:bigint,length:bigint>>, error string"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of a frame."""
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def write_file(payload: bytes) -> bytes:
    """A file of one video track whose samples are the payload's frames."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    wide = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(head) + len(mdat)
    starts = first + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, CHUNK_FRAMES if chunks > 1 else frames, 1)]
    if chunks > 1 and frames % CHUNK_FRAMES:
        runs.append((chunks, frames % CHUNK_FRAMES, 1))
    keys = np.arange(1, frames + 1, KEY_EVERY)
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64", struct.pack(">I", chunks), starts.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), starts.astype(">u4").tobytes()),
    )
    data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"text\0"),
        _box(b"minf", _full(b"vmhd", bytes(8), flags=1), data, table),
    )
    track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), bytes(8), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3), media)
    movie = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((head, mdat, payload, _box(b"moov", movie, track)))


def walk(data: memoryview, start: int = 0, end: int | None = None):
    """(path, body start, end) of every box, parents first. A size of 1 is followed by 64 bits, 0 reaches to the end."""
    open_ = [(start, len(data) if end is None else end, ())]
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("cut box header")
        length, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if length == 1:
            if end - start < 16:
                raise ValueError("cut box header")
            (length,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if length == 0 else start + length
        if stop < body or stop > end:
            raise ValueError(f"box {kind.decode('latin-1')} leaves its parent")
        if len(path) > DEEPEST:
            raise ValueError("boxes nested too deep")
        own = (*path, kind)
        yield own, body, stop
        open_.append((stop, end, path))
        if kind in _NESTED:
            open_.append((body, stop, own))


class _Box:
    """A box's body; what is read from it must lie inside."""

    def __init__(self, data: memoryview, at: int, end: int) -> None:
        self.data, self.at, self.end = data, at, end

    def read(self, form: str, at: int) -> tuple:
        if self.at + at + struct.calcsize(form) > self.end:
            raise ValueError("cut table")
        return struct.unpack_from(form, self.data, self.at + at)

    def numbers(self, form: str, at: int, columns: int = 1) -> np.ndarray:
        """The rows of a table: their count, then the rows. Numbers beyond 63 bits fit no file."""
        dtype = np.dtype(form)
        n = self.read(">I", at)[0] * columns
        if n * dtype.itemsize > self.end - self.at - at - 4:
            raise ValueError("cut table")
        found = np.frombuffer(self.data, dtype, n, self.at + at + 4)
        if n and dtype.itemsize == 8 and found.max() > 1 << 62:
            raise ValueError("samples leave the file")
        return found.astype(np.int64).reshape(-1, columns) if columns > 1 else found.astype(np.int64)


def _track(data: memoryview) -> dict[bytes, _Box]:
    """The boxes, by kind, of the first video track, or of the first track."""
    tracks: list[dict[bytes, _Box]] = []
    for path, body, end in walk(data):
        if path[-1] == b"trak" and path[:-1] == (b"moov",):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1].setdefault(path[-1], _Box(data, body, end))
    if not tracks:
        raise ValueError("no track")
    kind = lambda t: t[b"hdlr"].read("4s", 8)[0] if b"hdlr" in t else b""
    return next((t for t in tracks if kind(t) == b"vide"), tracks[0])


def read_tables(blob: bytes) -> dict:
    """What the tables of a file's track say; no payload byte is touched."""
    data = memoryview(blob)
    box = _track(data)
    missing = [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in box]
    if missing or not {b"stco", b"co64"} & box.keys():
        raise ValueError("no " + ", ".join(missing or ["chunk offsets"]))
    (version,) = box[b"mdhd"].read("B", 0)
    timescale, duration = box[b"mdhd"].read(">IQ", 20) if version == 1 else box[b"mdhd"].read(">II", 12)
    (codec,) = box[b"stsd"].read("4s", 12)
    described = box[b"stsd"]
    width, height = described.read(">HH", 40) if described.end - described.at >= 44 else (None, None)
    same, n = box[b"stsz"].read(">II", 4)
    if same and n * same > len(data):
        raise ValueError("samples leave the file")
    sizes = np.full(n, same, np.int64) if same else box[b"stsz"].numbers(">u4", 8)
    starts = box[b"stco"].numbers(">u4", 4) if b"stco" in box else box[b"co64"].numbers(">u8", 4)
    runs = box[b"stsc"].numbers(">u4", 4, 3)
    until = np.append(runs[1:, 0], len(starts) + 1)
    if (until < runs[:, 0]).any() or (len(runs) and (runs[0, 0] != 1 or (runs[:, 1] > n).any())) or (len(starts) > 0) != (len(runs) > 0):
        raise ValueError("sample tables disagree")
    per_chunk = np.repeat(runs[:, 1], until - runs[:, 0]) if len(starts) else np.zeros(0, np.int64)
    if len(per_chunk) != len(starts) or per_chunk.sum() != n:
        raise ValueError("sample tables disagree")
    chunk = np.repeat(np.arange(len(starts)), per_chunk)
    before = np.concatenate(([0], np.cumsum(sizes)))
    firsts = np.concatenate(([0], np.cumsum(per_chunk)))
    place = starts[chunk] + before[:-1] - before[firsts[:-1]][chunk] if n else sizes
    lengths = before[firsts[1:]] - before[firsts[:-1]]
    if len(starts) and (starts + lengths).max() > len(data):
        raise ValueError("samples leave the file")
    if lengths.sum() > len(data):  # overlapping chunks would read back more than the file holds
        raise ValueError("samples overlap")
    if b"stss" in box:
        keys = box[b"stss"].numbers(">u4", 4) - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= n or len(keys) > n):
            raise ValueError("a keyframe is no sample")
    else:
        keys = np.arange(n)
    times = box[b"stts"].numbers(">u4", 4, 2)
    if times[:, 0].sum() != n:
        raise ValueError("sample tables disagree")
    lasts = sum(a * b for a, b in times.tolist()) or duration
    if max(lasts, timescale) >= 1 << 63:
        raise ValueError("no duration")
    ranges = lambda a, b: [{"start": int(x), "length": int(y)} for x, y in zip(a, b, strict=True)]
    return {"codec": codec.decode("latin-1"), "width": width, "height": height, "timescale": timescale, "duration": lasts,
            "n_samples": n, "keyframes": ranges(place[keys], sizes[keys]), "chunks": ranges(starts, lengths), "error": None}


def write_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with n_bytes (of the text in UTF-8, before padding) and a media file per row."""

    def fn(text):
        raw = [x.encode() if x is not None else b"" for x in text.to_pylist()]
        return [[len(x) for x in raw], [write_file(pad(x)) for x in raw]]

    return map_columns(df, {"text": text_col}, f"n_bytes bigint, `{media_col}` binary", fn)


def read_media(df: DataFrame, media_col: str = "media", payload_col: str | None = "payload") -> DataFrame:
    """``df`` with a struct ``tables`` (see read_tables) and, if asked for, the samples' bytes in file order."""
    names = ["codec", "width", "height", "timescale", "duration", "n_samples", "keyframes", "chunks", "error"]

    def fn(media):
        tables, payloads = [], []
        for blob in media.to_pylist():
            try:
                if blob is None:
                    raise ValueError("no file")
                found = read_tables(blob)
                payload = b"".join(blob[x["start"] : x["start"] + x["length"]] for x in found["chunks"])
            except (ValueError, struct.error) as e:
                found, payload = dict.fromkeys(names) | {"error": str(e)}, None
            tables.append(found)
            payloads.append(payload)
        return [tables, payloads] if payload_col else [tables]

    return map_columns(df, {"media": media_col}, f"tables struct<{_TABLES.replace(' ', ':').replace(',:', ',')}>" + (f", `{payload_col}` binary" if payload_col else ""), fn)


def feature(tables: str = "tables"):
    """One line of a file's tables: codec, frame, duration, and the first and last keyframe's bytes."""
    t = F.col(tables)
    span = lambda x: F.concat_ws("+", x["start"], x["length"])
    return F.concat_ws(";", F.concat(F.lit("codec="), F.trim(t["codec"])), F.concat(F.lit("frame="), t["width"], F.lit("x"), t["height"]),
                       F.concat(F.lit("duration="), t["duration"], F.lit("/"), t["timescale"]), F.concat(F.lit("samples="), t["n_samples"]),
                       F.concat(F.lit("keyframes="), F.size(t["keyframes"])), F.concat(F.lit("first="), span(F.get(t["keyframes"], 0))),
                       F.concat(F.lit("last="), span(F.element_at(t["keyframes"], -1))))
