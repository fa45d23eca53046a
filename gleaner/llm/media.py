"""ISO media containers as columns (operator 10).

``pack`` writes bytes as the frames of an ISO base media file; ``inspect`` walks the
nested boxes of such a file, decodes the sample tables and the runs of movie fragments,
and tells codec, duration and the byte ranges of keyframes without decoding any payload.

Defined results: a null text counts as empty; empty texts get one padded frame; equal
texts give equal values; repeated rows give repeated results; extra columns are
ignored. For a malformed file ``inspect`` raises ``ValueError``; ``media_columns`` gives it
one row with the reason in ``error``, and other files are not touched by it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import kind_of, lean, small_batches

#: A frame is 8 x 8 samples of 8 bits.
FRAME, SIDE = 64, 8
#: Frames a second, frames in a chunk, and frames from one listed sync sample to the next.
RATE, CHUNK, SYNC = 25, 256, 16
#: Boxes that hold boxes. (Fixed by the container format.)
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of a frame."""
    return data + bytes(-len(data) % FRAME or (0 if data else FRAME))


def _tables(frames: int, first: int) -> bytes:
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, last)] * (last != CHUNK or chunks == 1)
    places = first + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
    wide = frames * FRAME + first >= 1 << 32
    sync = np.arange(1, frames + 1, SYNC, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">2H2IIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    return box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">3I", 1, frames, 1)),
        full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", a, n, 1) for a, n in runs)),
        full(b"stsz", struct.pack(">2I", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
    )


def pack(payload: bytes) -> bytes:
    """A file with one track whose frames are the payload's 64-byte pieces, stored as they are."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(first: int) -> bytes:
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, frames, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), _tables(frames, first)),
        )
        track = full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=3)
        return box(b"moov", full(b"mvhd", struct.pack(">4IIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), box(b"trak", track, media))

    data = box(b"mdat", payload)
    room = len(head) + len(movie(0)) + len(data) - len(payload)
    return head + movie(room) + data


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, start and end of the body, start of the box) of every box, parents before what they hold."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} does not fit what holds it")
        yield (*path, kind), body, at + size, at
        if kind in PARENTS:
            yield from walk(data, body, at + size, (*path, kind))
        at += size


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=_none)
    starts: np.ndarray = field(default_factory=_none)
    sync: np.ndarray = field(default_factory=_none)

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges, end exclusive."""
        return [(int(self.starts[i]), int(self.starts[i] + self.sizes[i])) for i in self.sync]


def _u32(data: bytes, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def _numbers(data: bytes, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _sizes(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stsz" in boxes:
        at = boxes[b"stsz"][0]
        each, n = _u32(data, at + 4), _u32(data, at + 8)
        if each * n > len(data):
            raise ValueError("the samples are larger than the file")
        return np.full(n, each, np.int64) if each else _numbers(data, at + 12, n)
    if b"stz2" in boxes:
        at = boxes[b"stz2"][0]
        bits, n = data[at + 7], _u32(data, at + 8)
        if bits == 4:
            pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
        return _numbers(data, at + 12, n, ">u2" if bits == 16 else ">u1")
    return _none()


def _starts(data: bytes, boxes: dict[bytes, tuple[int, int]], sizes: np.ndarray) -> np.ndarray:
    """Where each sample begins: chunks have places, and runs of chunks have numbers of samples."""
    if not len(sizes):
        return sizes
    places = next(((boxes[k][0], kind) for k, kind in ((b"co64", ">u8"), (b"stco", ">u4")) if k in boxes), None)
    if places is None or b"stsc" not in boxes:
        raise ValueError("samples without chunks")
    chunks = _numbers(data, places[0] + 8, _u32(data, places[0] + 4), places[1])
    at = boxes[b"stsc"][0]
    runs = _numbers(data, at + 8, 3 * _u32(data, at + 4)).reshape(-1, 3)
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if not len(runs) or runs[0, 0] != 1 or (lengths < 0).any():
        raise ValueError("runs of chunks out of order")
    held = np.repeat(runs[:, 1], lengths)
    if held.sum() < len(sizes):
        raise ValueError("the chunks hold fewer samples than have sizes")
    upto = np.cumsum(held)
    chunk = np.searchsorted(upto, np.arange(len(sizes)), side="right")
    before = np.cumsum(sizes) - sizes
    opens = np.append(True, chunk[1:] != chunk[:-1])
    return chunks[chunk] + before - np.maximum.accumulate(np.where(opens, before, 0))


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    out = Track()
    if b"tkhd" in boxes:
        at = boxes[b"tkhd"][0]
        out.number = _u32(data, at + (20 if data[at] else 12))
    if b"mdhd" in boxes:
        at = boxes[b"mdhd"][0]
        out.timescale, out.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    if b"stsd" in boxes:
        at = boxes[b"stsd"][0]
        out.codec = data[at + 12 : at + 16].decode("latin-1") if _u32(data, at + 4) else ""
    out.sizes = _sizes(data, boxes)
    out.starts = _starts(data, boxes, out.sizes)
    if b"stss" in boxes:
        at = boxes[b"stss"][0]
        out.sync = _numbers(data, at + 8, _u32(data, at + 4)) - 1
    else:
        out.sync = np.arange(len(out.sizes))
    return out


#: Flags of fragment headers and runs, and of a sample that is no keyframe. (Fixed by the container format.)
BASE_OFFSET, DESCRIPTION, DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
DATA_OFFSET, FIRST_FLAGS, DURATIONS, SIZES, FLAGS, COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_SYNC = 0x10000


@dataclass
class _Fragment:
    """A track's part of one movie fragment: where its data begin, and what holds for samples that say nothing."""

    number: int
    base: int
    duration: int
    size: int
    flags: int

    @classmethod
    def read(cls, data: bytes, at: int, moof: int, behind: int | None, defaults: dict[int, tuple[int, int, int]]) -> _Fragment:
        flags, number = _u32(data, at) & 0xFFFFFF, _u32(data, at + 4)
        duration, size, sample_flags = defaults.get(number, (0, 0, 0))
        base = moof if behind is None or flags & BASE_IS_MOOF else behind
        at += 8
        if flags & BASE_OFFSET:
            base = struct.unpack_from(">Q", data, at)[0]
            at += 8
        at += 4 * bool(flags & DESCRIPTION)
        if flags & DEFAULT_DURATION:
            duration = _u32(data, at)
            at += 4
        if flags & DEFAULT_SIZE:
            size = _u32(data, at)
            at += 4
        if flags & DEFAULT_FLAGS:
            sample_flags = _u32(data, at)
        return cls(number, base, duration, size, sample_flags)


def _run(data: bytes, at: int, end: int, part: _Fragment, place: int, track: Track) -> int:
    """Adds a run's samples to the track; where its data end."""
    flags, n = _u32(data, at) & 0xFFFFFF, _u32(data, at + 4)
    at += 8
    if flags & DATA_OFFSET:
        place = part.base + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & FIRST_FLAGS:
        first = _u32(data, at)
        at += 4
    told = [k for k in (DURATIONS, SIZES, FLAGS, COMPOSITION) if flags & k]
    if at + 4 * n * len(told) > end or (not told and n * part.size > len(data)):
        raise ValueError("a run of samples is cut short")
    table = _numbers(data, at, n * len(told)).reshape(n, len(told))
    column = lambda k, other: table[:, told.index(k)] if k in told else np.full(n, other, np.int64)
    sizes, sample_flags = column(SIZES, part.size), column(FLAGS, part.flags).copy()
    if first is not None and n:
        sample_flags[0] = first
    ends = place + np.cumsum(sizes)
    track.sync = np.append(track.sync, len(track.sizes) + np.flatnonzero(sample_flags & NO_SYNC == 0))
    track.sizes, track.starts = np.append(track.sizes, sizes), np.append(track.starts, ends - sizes)
    track.duration += int(column(DURATIONS, part.duration).sum())
    return int(ends[-1]) if n else place


def inspect(data: bytes) -> list[Track]:
    """The tracks of a file, in its order; ``ValueError`` if it is malformed."""
    try:
        return _inspected(data)
    except (IndexError, struct.error, OverflowError) as e:
        raise ValueError(f"malformed: {e}") from e


def _inspected(data: bytes) -> list[Track]:
    boxes: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    runs: list[tuple[int, int, int, bytes]] = []
    for path, start, end, at in walk(data):
        if path[-1] == b"trak":
            boxes.append({})
        elif boxes and b"trak" in path:
            boxes[-1].setdefault(path[-1], (start, end))
        elif path[-1] == b"trex":
            defaults[_u32(data, start + 4)] = struct.unpack_from(">3I", data, start + 12)
        elif path[-1] in (b"moof", b"traf", b"tfhd", b"trun"):
            runs.append((start, end, at, path[-1]))
    tracks = [_track(data, t) for t in boxes]
    by_number = {t.number: t for t in tracks}
    moof, behind, place, part = 0, None, 0, None
    for start, end, at, kind in runs:
        if kind == b"moof":
            moof, behind, part = at, None, None
        elif kind == b"traf":
            part = None
        elif kind == b"tfhd":
            part = _Fragment.read(data, start, moof, behind, defaults)
            place = part.base
        elif part is None or part.number not in by_number:
            raise ValueError("a run of samples without a track")
        else:
            place = behind = _run(data, start, end, part, place, by_number[part.number])
    for t in tracks:
        if len(t.sync) and not 0 <= t.sync.min() <= t.sync.max() < len(t.sizes):
            raise ValueError("a sync sample that is none")
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The track's samples, read by its tables; adjacent samples are read together."""
    if not len(track.sizes):
        return b""
    ends = track.starts + track.sizes
    cuts = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(ends)) - 1
    if ends.max() > len(data):
        raise ValueError("a sample ends behind the file")
    return b"".join(data[track.starts[a] : ends[b]] for a, b in zip(firsts, lasts, strict=True))


def feature(track: Track) -> str:
    """Codec, duration, samples and keyframes in one line; all ranges count in its last part."""
    keys = track.keyframes()
    ranges = ",".join(f"{a}-{b}" for a, b in keys)
    first, last = (f"{a}-{b}" for a, b in (keys[0], keys[-1])) if keys else ("", "")
    return f"codec={track.codec.strip()};seconds={track.seconds:.2f};samples={len(track.sizes)};keyframes={len(keys)};first={first};last={last};ranges={zlib.crc32(ranges.encode()):08x}"


def media_columns(files: DataFrame, key: str = "media_id", content: str = "content") -> DataFrame:
    """Per track of each file: key, ``track``, ``codec``, ``seconds``, ``samples``, ``keyframes`` array of byte ranges, ``error``.

    A null or empty content has no tracks. A malformed file has one row, with ``error`` and nulls.
    """
    small_batches(files.sparkSession)
    shape = f"`{key}` {kind_of(files, key)}, track int, codec string, seconds double, samples long, keyframes array<struct<start:long,end:long>>, error string"

    def rows_of(i: int, data: bytes | None):
        try:
            for k, t in enumerate(inspect(data) if data else []):
                yield i, k, t.codec, t.seconds, len(t.sizes), [{"start": a, "end": b} for a, b in t.keyframes()], None
        except ValueError as e:
            yield i, None, None, None, None, None, str(e)

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        for batch in batches:
            rows = [r for i, data in enumerate(batch.column(1).to_pylist()) for r in rows_of(i, data)]
            cols = [pa.array(c, kind) for c, kind in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            yield pa.record_batch([batch.column(0).take(cols[0]), *cols[1:]], names=[key, "track", "codec", "seconds", "samples", "keyframes", "error"])

    return files.select(key, content).mapInArrow(lean(run), shape)


DIGEST = (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"))


def digest(text: str | None) -> tuple:
    """Store a text, read the stored file back by its tables, and tell what came back."""
    data = (text or "").encode()
    stored = pack(pad(data))
    track = inspect(stored)[0]
    back = payload(stored, track)
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track)


def stored_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the key and what ``digest`` tells of its text."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in DIGEST]

    def run(batches):
        for batch in batches:
            cols = zip(*map(digest, batch.column(1).to_pylist()), strict=True)
            cols = list(cols) or [()] * len(kinds)
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, *(n for n, _ in DIGEST)])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind_of(docs, key)}, " + ", ".join(f"{n} {k}" for n, k in DIGEST))
