"""Media columns: ISO base media containers.

:func:`store_media` keeps the bytes of a text as 8-bit PCM samples in an ISO
container, :func:`probe_media` walks the nested boxes of any such container,
decodes the sample tables (and fragments) of every track and stores codec,
duration and the byte ranges of the keyframes.  No payload is decoded for that.  :func:`read_payload` returns the
sample bytes that the tables point to.

Defined cases: null text is stored as the empty text (one padded frame); bytes
that aren't a container, whose tables are cut short, promise more samples than the
file has bytes, or are nested beyond ``DEPTH``, give null columns and never fail the
job; nothing is allocated before it was checked against the file's length; texts of any
length are stored whole; repeated rows give repeated results; an empty table gives an
empty table; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_slices, texts

#: Fixed values of the format (ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
CODEC = b"raw "
#: Nesting of boxes that is followed.
DEPTH = 32

#: 8-bit samples in a frame, frames in a chunk (the first of each is a keyframe), samples a second.
FRAME, CHUNK_FRAMES, RATE = 576, 16, 8000
PAD = b"\xff"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of :data:`FRAME`."""
    return data + PAD * (FRAME if not data else -len(data) % FRAME)


def mux(payload: bytes) -> bytes:
    """One audio track of 8-bit samples; ``payload`` is a positive multiple of :data:`FRAME` bytes."""
    frames = len(payload) // FRAME
    duration = len(payload)
    chunks = -(-frames // CHUNK_FRAMES)
    rest = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES)] if chunks > 1 else []
    if not runs or rest != CHUNK_FRAMES:
        runs.append((chunks, rest))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (FRAME * CHUNK_FRAMES)
        wide = int(starts[-1]) >= 1 << 32
        entry = box(CODEC, bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, struct.pack(">III", 1, frames, FRAME)),
            full(b"stss", 0, struct.pack(">I", chunks), (np.arange(chunks) * CHUNK_FRAMES + 1).astype(">u4").tobytes()),
            full(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
            full(b"stsz", 0, struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", 0, bytes(4)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), stbl)
        mdia = box(
            b"mdia",
            full(b"mdhd", 0x1000000, struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0)),
            full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
            minf,
        )
        tkhd = full(b"tkhd", 0x1000007, struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), IDENTITY, bytes(8))
        mvhd = full(b"mvhd", 0x1000000, struct.pack(">QQIQIH10x", 0, 0, RATE, duration, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    if head + len(payload) >= 1 << 32:  # wide chunk offsets make the table itself longer
        head = len(ftyp) + len(moov(1 << 32)) + 16
    return ftyp + moov(head) + box(b"mdat", payload)


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end of the body) of each box, containers included, in file order; nesting deeper than ``DEPTH`` is an error."""
    open_ = [(start, end, ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError("a box reaches beyond its parent")
        yield (*path, kind), body, stop
        open_.append((stop, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise ValueError("boxes are nested too deep")
            open_.append((body, stop, (*path, kind)))


def _header(data: memoryview, body: int) -> int:
    """The version and flags of a full box; the flags are the lower 24 bits."""
    return struct.unpack_from(">I", data, body)[0]


def _fragments(data: memoryview, tops: list[tuple[bytes, int, int, int]]) -> dict[int, list[tuple[int, int, int, bool]]]:
    """(offset, size, duration, whether it is a keyframe) of the samples of each track id that movie fragments hold, in order."""
    defaults: dict[int, tuple[int, ...]] = {}
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    for kind, start, body, stop in tops:
        if kind == b"moov":
            for path, a, _ in walk(data, body, stop):
                if path[-1] == b"trex":
                    track, _, *rest = struct.unpack_from(">5I", data, a + 4)
                    defaults[track] = tuple(rest)  # duration, size, flags
        if kind != b"moof":
            continue
        at, base, track, values = start, start, 0, [0, 0, 0]
        first_traf = True
        for path, a, b in walk(data, body, stop):
            if path[-1] == b"traf":
                values, track = [0, 0, 0], 0
            elif path[-1] == b"tfhd":
                flags, track = _header(data, a) & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
                values, p = list(defaults.get(track, (0, 0, 0))), a + 8
                # Data starts at the given place, at the fragment, or where the data of the track before ends.
                base = start if first_traf or flags & 0x20000 else at
                if flags & 1:
                    (base,), p = struct.unpack_from(">Q", data, p), p + 8
                p += 4 if flags & 2 else 0
                for k, bit in enumerate((0x8, 0x10, 0x20)):
                    if flags & bit:
                        (values[k],), p = struct.unpack_from(">I", data, p), p + 4
                at, first_traf = base, False
            elif path[-1] == b"trun":
                flags, p = _header(data, a) & 0xFFFFFF, a + 8
                (n,) = struct.unpack_from(">I", data, a + 4)
                if flags & 1:
                    at, p = base + struct.unpack_from(">i", data, p)[0], p + 4
                first = None
                if flags & 4:
                    (first,), p = struct.unpack_from(">I", data, p), p + 4
                width = 4 * sum(bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800))
                if p + n * width > b or n > len(data):
                    raise ValueError("a run is cut short")
                for i in range(n):
                    own = list(values)
                    for k, bit in enumerate((0x100, 0x200, 0x400)):
                        if flags & bit:
                            (own[k],), p = struct.unpack_from(">I", data, p), p + 4
                    p += 4 if flags & 0x800 else 0
                    if i == 0 and first is not None and not flags & 0x400:
                        own[2] = first
                    if at < 0 or at + own[1] > len(data):
                        raise ValueError("a sample lies outside the file")
                    out.setdefault(track, []).append((at, own[1], own[0], not own[2] & 0x10000))
                    at += own[1]
    return out


def _track(data: memoryview, found: dict[bytes, tuple[int, int]], fragments: dict[int, list[tuple[int, int, int, bool]]]) -> dict:
    """Codec, time scale, duration and the samples of one track, from its boxes (kind: body) and its fragments."""

    def table(kind: bytes, skip: int, dtype: str, width: int = 1) -> np.ndarray:
        a, b = found[kind]
        (n,) = struct.unpack_from(">I", data, a + skip - 4)
        if a + skip + n * width * np.dtype(dtype).itemsize > b:
            raise ValueError("a table is cut short")
        return np.frombuffer(data, dtype, n * width, a + skip).astype(np.int64).reshape(-1, width)

    a, _ = found[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    a, _ = found[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, a + 4)
    if fixed and n * fixed > len(data):
        raise ValueError("samples lie outside the file")
    sizes = np.full(n, fixed, np.int64) if fixed else table(b"stsz", 12, ">u4")[:, 0]
    chunks = table(b"co64", 8, ">u8")[:, 0] if b"co64" in found else table(b"stco", 8, ">u4")[:, 0]
    runs = table(b"stsc", 8, ">u4", 3)
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)  # samples of each chunk
    if len(each) and int(each[:-1].sum()) <= n <= int(each.sum()):
        each[-1] = n - int(each[:-1].sum())
    elif n or len(each):
        raise ValueError("chunks don't hold the samples")
    chunk = np.repeat(np.arange(len(chunks)), each)
    before = np.cumsum(sizes) - sizes
    first = (np.cumsum(each) - each)[chunk]  # the first sample of each sample's chunk
    offsets = chunks[chunk] + before - before[first]
    if n and int((offsets + sizes).max()) > len(data):
        raise ValueError("a sample lies outside the file")
    keys = table(b"stss", 8, ">u4")[:, 0] - 1 if b"stss" in found else np.arange(n)
    times = table(b"stts", 8, ">u4", 2)
    total = int((times[:, 0] * times[:, 1]).sum())
    more = fragments.get(struct.unpack_from(">I", data, found[b"tkhd"][0] + (20 if data[found[b"tkhd"][0]] == 1 else 12))[0], []) if b"tkhd" in found else []
    if more:
        at, size, time, sync = (np.array(c, np.int64) for c in zip(*more, strict=True))
        offsets, sizes, keys, total, n = np.append(offsets, at), np.append(sizes, size), np.append(keys, n + np.flatnonzero(sync)), total + int(time.sum()), n + len(more)
    return {"codec": codec, "timescale": scale, "duration": total or duration, "samples": n, "offsets": offsets, "sizes": sizes, "keys": keys}


#: What cut or foreign bytes raise.
BROKEN = (TypeError, ValueError, KeyError, IndexError, struct.error)


def sample_tables(media: bytes) -> list[dict | None]:
    """:func:`sample_table` of every track, in file order; None for a track whose tables are cut short or missing."""
    data = memoryview(media)
    tops, at = [], 0
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data, 0, len(data)):
        if len(path) == 1:
            tops.append((path[0], at, a, b))
            at = b
        elif path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak") and path[-1] not in CONTAINERS:
            tracks[-1].setdefault(path[-1], (a, b))
    fragments, out = _fragments(data, tops), []
    for found in tracks:
        try:
            t = _track(data, found, fragments)
            t["offsets"][t["keys"]]  # keyframes are samples
            out.append(t)
        except BROKEN:
            out.append(None)
    return out


def sample_table(media: bytes) -> dict:
    """Codec, time scale, duration and the samples of the first track, from the boxes alone."""
    found = sample_tables(media)
    if not found or found[0] is None:
        raise ValueError("no track that can be read comes first")
    return found[0]


def demux(media: bytes, found: dict) -> bytes:
    """The bytes of all samples, in order."""
    a, b = found["offsets"], found["offsets"] + found["sizes"]
    if not len(a):
        return b""
    cut = np.flatnonzero(a[1:] != b[:-1])
    starts, ends = a[np.append(0, cut + 1)], b[np.append(cut, len(b) - 1)]
    return b"".join(media[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True))


def store_media(df: DataFrame, text: str = "text", into: str = "media", *keep: str) -> DataFrame:
    """``keep`` and the container of each text's UTF-8 bytes, with their number as ``n_bytes``."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode() for t in texts(batch.column(0))]
            made = [pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*keep, "n_bytes", into])

        return step

    return map_slices(df.select(text, *keep), start, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "n_bytes long", f"`{into}` binary"]))


def probe_media(df: DataFrame, media: str = "media", *keep: str, payload: bool = False) -> DataFrame:
    """``keep`` with codec, timescale, duration, samples and keyframes (start, end) of the first track, and its payload if asked for.

    ``tracks`` holds the same five for every track, in file order; samples of movie fragments are counted in.
    """
    ranges = "keyframes: array<struct<start: long, end: long>>"

    def start():
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names, kinds = ["codec", "timescale", "duration", "samples", "keyframes"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), kind]
        entry = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))

        def columns(t: dict | None) -> tuple:
            if t is None:
                return (None,) * 5
            a = t["offsets"][t["keys"]]
            keys = [{"start": s, "end": e} for s, e in zip(a.tolist(), (a + t["sizes"][t["keys"]]).tolist(), strict=True)]
            return t["codec"], t["timescale"], t["duration"], t["samples"], keys

        def probe(x: bytes | None) -> tuple:
            try:
                found = sample_tables(x)
            except BROKEN:
                return (None,) * 7
            made = [columns(t) for t in found]
            first = found[0] if found else None
            return (*(made[0] if made else (None,) * 5), [dict(zip(names, m, strict=True)) for m in made], demux(x, first) if payload and first else None)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = list(zip(*map(probe, batch.column(0).to_pylist()), strict=True)) or [()] * 7
            made = [pa.array(list(c), k) for c, k in zip(got, (*kinds, entry, pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *made[: 6 + payload]], [*keep, *names, "tracks", *["payload"] * payload])

        return step

    new = ["codec string", "timescale long", "duration long", "samples long", ranges.replace(":", "", 1), f"tracks array<struct<codec: string, timescale: long, duration: long, samples: long, {ranges}>>", *["payload binary"] * payload]
    return map_slices(df.select(media, *keep), start, ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), *new]))


def feature() -> Column:
    """One line with what :func:`probe_media` found."""
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat(k["start"].cast("string"), F.lit("-"), k["end"].cast("string"))), ",")
    return F.concat_ws(";", F.trim("codec"), F.concat(F.col("duration").cast("string"), F.lit("/"), F.col("timescale").cast("string")), F.col("samples").cast("string"), ranges)
