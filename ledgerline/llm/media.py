"""Media columns: index ISO base media files from their boxes, without decoding payloads.

:func:`index_media` adds, for a binary column of ISO media files, the codec, the
duration and the byte ranges of the sync samples ("keyframes") of the first media track.
The nested boxes are walked and the sample tables (stsd, stts, stsc, stsz, stco/co64,
stss) are decoded; sample payloads are never touched. :func:`store_payload` is the
opposite direction: it wraps bytes losslessly as 8-bit PCM samples of one audio track.

Defined cases: a null file gives nulls; a file that is truncated, empty or has no track
gives codec null, no ranges and an ``error`` text, never an exception. Columns of the
input keep their values; a clashing output name raises ``ValueError`` up front. Equal
files give equal rows, whatever the order of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, text_runs

#: Bytes of one stored frame: a payload is padded to a multiple of this.
FRAME = 576
#: Frames that share one chunk of the file.
FRAMES_PER_CHUNK = 16
#: Samples a second that the track header states.
RATE = 8000
#: Boxes that hold only other boxes (fixed values of the format).
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"))
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of :data:`FRAME`."""
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def store_payload(payload: bytes) -> bytes:
    """One ISO media file whose only track holds ``payload`` as 8-bit PCM, a frame a sample.

    The length must be a positive multiple of :data:`FRAME`. Every PCM frame can be
    decoded alone, so there is no stss box: all samples are sync samples.
    """
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError(f"payload must be a positive multiple of {FRAME} bytes")
    ticks = len(payload)
    full_chunks, last = divmod(frames, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK)] if full_chunks else []
    if last:
        runs.append((full_chunks + 1, last))
    chunks = full_chunks + bool(last)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    long_times = ticks >= 1 << 32
    times = ">QQIQ" if long_times else ">IIII"
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  isom")
    head = len(ftyp) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    offsets = [head + k * FRAMES_PER_CHUNK * FRAME for k in range(chunks)]
    wide = offsets[-1] >= 1 << 32
    stco = _full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
    stbl = _box(
        b"stbl",
        _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        _full(b"stts", 0, 0, struct.pack(">III", 1, frames, FRAME)),
        _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
        _full(b"stsz", 0, 0, struct.pack(">II", FRAME, frames)),
        stco,
    )
    dref = _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))
    minf = _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", dref), stbl)
    mdhd = _full(b"mdhd", int(long_times), 0, struct.pack(times, 0, 0, RATE, ticks), struct.pack(">HH", 0x55C4, 0))
    hdlr = _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"\0")
    track = struct.pack(">QQIIQ" if long_times else ">IIIII", 0, 0, 1, 0, ticks)
    tkhd = _full(b"tkhd", int(long_times), 7, track, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8))
    mvhd = _full(
        b"mvhd", int(long_times), 0, struct.pack(times, 0, 0, RATE, ticks),
        struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2),
    )
    return b"".join((ftyp, _box(b"mdat", payload), _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the body, end) of each box between two places."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a large box without its size")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} doesn't fit its parent")
        yield kind, body, at + size
        at += size


#: Boxes inside boxes, at most; the format's own tables stand six deep.
MAX_DEPTH = 32


def _tree(data: memoryview, start: int, end: int, depth: int = 0) -> dict[bytes, list]:
    """Boxes by type: containers as such dictionaries, leaves as (start, end) of their bodies."""
    if depth > MAX_DEPTH:
        raise ValueError(f"boxes are nested more than {MAX_DEPTH} deep")
    found: dict[bytes, list] = {}
    for kind, body, stop in boxes(data, start, end):
        found.setdefault(kind, []).append(_tree(data, body, stop, depth + 1) if kind in CONTAINERS else (body, stop))
    return found


@dataclass(frozen=True)
class MediaIndex:
    """What the boxes of a file say about its first media track."""

    codec: str
    handler: str
    timescale: int
    duration_ticks: int
    n_samples: int
    #: (offset, size) of runs of sync samples that lie back to back in the file.
    key_ranges: tuple[tuple[int, int], ...]
    n_sync: int

    @property
    def duration_s(self) -> float:
        return self.duration_ticks / self.timescale if self.timescale else 0.0


def _table(data: memoryview, span: tuple[int, int], skip: int, fields: str) -> list[tuple]:
    """Rows of a counted table: ``skip`` bytes after version and flags, then count and rows."""
    start, end = span
    (n,) = struct.unpack_from(">I", data, start + 4 + skip)
    row = struct.Struct(">" + fields)
    first = start + 8 + skip
    if first + n * row.size > end:
        raise ValueError("a sample table is cut short")
    return list(row.iter_unpack(data[first : first + n * row.size]))


def _sizes(data: memoryview, stbl: dict) -> tuple[int, list[int] | None, int]:
    """(size that all samples share or 0, their sizes else, number of samples)."""
    start, _ = stbl[b"stsz"][0]
    same, n = struct.unpack_from(">II", data, start + 4)
    if same:
        if same * n > len(data):
            raise ValueError("more samples than the file has bytes for")
        return same, None, n
    return 0, [r[0] for r in _table(data, stbl[b"stsz"][0], 4, "I")], n


def parse(file: bytes) -> MediaIndex:
    """Index of the first video track that has a sample table, else of the first such track.

    ``ValueError`` where there is none, and for fragmented files: their samples stand
    outside the sample tables, so an index of these would not be whole.
    """
    data = memoryview(file)
    try:
        top = _tree(data, 0, len(data))
        if b"moof" in top or any(b"mvex" in m for m in top.get(b"moov", ())):
            raise ValueError("a fragmented file: its sample tables are not whole")
        tracks = [t for m in top.get(b"moov", ()) for t in m.get(b"trak", ())]
        media = [m for t in tracks for m in t.get(b"mdia", ()) if b"stbl" in m.get(b"minf", [{}])[0]]
        video = [m for m in media if bytes(data[m[b"hdlr"][0][0] + 8 :][:4]) == b"vide"]
        mdia = (video or media)[0]
        stbl = mdia[b"minf"][0][b"stbl"][0]
        at, _ = mdia[b"mdhd"][0]
        timescale, ticks = struct.unpack_from(">16xIQ" if data[at] == 1 else ">8xII", data, at + 4)
        handler = bytes(data[mdia[b"hdlr"][0][0] + 8 :][:4]).decode("latin-1")
        codec = bytes(data[stbl[b"stsd"][0][0] + 12 :][:4]).decode("latin-1")
        same, sizes, n = _sizes(data, stbl)
        durations = _table(data, stbl[b"stts"][0], 0, "II")
        chunk_runs = _table(data, stbl[b"stsc"][0], 0, "III")
        wide = b"co64" in stbl
        offsets = [r[0] for r in _table(data, stbl[b"co64" if wide else b"stco"][0], 0, "Q" if wide else "I")]
        sync = {r[0] - 1 for r in _table(data, stbl[b"stss"][0], 0, "I")} if b"stss" in stbl else None
    except (struct.error, KeyError, IndexError, StopIteration) as e:
        raise ValueError(f"no complete media track: {type(e).__name__}") from e
    ranges: list[list[int]] = []

    def add(place: int, size: int) -> None:
        if ranges and sum(ranges[-1]) == place:
            ranges[-1][1] += size
        else:
            ranges.append([place, size])

    sample, after = 0, [run[0] for run in chunk_runs[1:]] + [len(offsets) + 1]
    if any(not 1 <= run[0] < nxt <= len(offsets) + 1 for run, nxt in zip(chunk_runs, after, strict=True)):
        raise ValueError("runs of chunks that are not there")
    for (first, per_chunk, _entry), nxt in zip(chunk_runs, after, strict=True):
        for place in offsets[first - 1 : nxt - 1]:
            here = min(per_chunk, n - sample)
            if same and sync is None and here:
                add(place, same * here)
            else:
                for k in range(sample, sample + here):
                    size = same or sizes[k]
                    if sync is None or k in sync:
                        add(place, size)
                    place += size
            sample += here
    if sample < n:
        raise ValueError("samples without a chunk")
    if any(o + s > len(file) for o, s in ranges):
        raise ValueError("samples lie beyond the file's end")
    total = sum(count * delta for count, delta in durations) or ticks
    n_sync = n if sync is None else sum(1 for s in sync if 0 <= s < n)
    return MediaIndex(codec, handler, timescale, total, n, tuple(map(tuple, ranges)), n_sync)


def index_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` without the file bytes, plus codec, handler, duration_s, n_samples, n_sync, key_ranges, error."""
    names = ["codec", "handler", "duration_s", "n_samples", "n_sync", "key_ranges", "error"]
    keep = [c for c in df.columns if c != media]
    if clash := {c.lower() for c in keep} & set(names):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    ship(df.sparkSession)
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), ranges, pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, media):
            rows = []
            for x in batch.column(media):
                try:
                    file = x.as_py()
                    rows.append((None,) * 7 if file is None else _row(parse(file)))
                except ValueError as e:
                    rows.append((None, None, None, None, None, [], str(e)))
            columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, names=keep + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != media])
    extra = "codec string, handler string, duration_s double, n_samples bigint, n_sync bigint, key_ranges array<struct<offset:bigint,size:bigint>>, error string"
    return df.mapInArrow(run, f"{schema}, {extra}" if schema else extra)


def _row(m: MediaIndex) -> tuple:
    return m.codec, m.handler, m.duration_s, m.n_samples, m.n_sync, [{"offset": o, "size": s} for o, s in m.key_ranges], None


def text_media_digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store each text as media, index the stored file, read its sync ranges back, digest both.

    Null texts count as empty. The bytes read back come from the ranges that the sample
    tables give, so a wrong table gives a wrong ``payload_sha256``.
    """
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, text):
            out = [_digest((t.as_py() or "").encode()) for t in batch.column(text)]
            columns = [pa.array(list(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *_DIGEST])

    source = df.select(key, text)
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{k} {v}" for k, v in _DIGEST.items()))


_DIGEST = {
    "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint",
    "media_bytes": "bigint", "media_sha256": "string", "feature": "string", "n_key_ranges": "bigint",
}


def _digest(raw: bytes) -> tuple:
    file = store_payload(pad(raw))
    index = parse(file)
    back = b"".join(file[o : o + s] for o, s in index.key_ranges)
    spans = ",".join(f"{o}+{s}" for o, s in index.key_ranges)
    feature = f"{index.codec.strip()}/{index.handler};{index.duration_ticks}/{index.timescale}s;samples={index.n_samples};sync={index.n_sync};ranges={spans}"
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]),
        len(file), hashlib.sha256(file).hexdigest(), feature, len(index.key_ranges),
    )
