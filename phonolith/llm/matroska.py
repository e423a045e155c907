"""Matroska media columns: EBML elements, clusters, lacing and cues to packet tables and back.

``mux()`` writes one PCM track (8 bits, mono, 8 kHz) in frames of fixed size; ``parse()`` reads any Matroska bytes:
variable-length ids and sizes (also unknown sizes), SimpleBlocks and BlockGroups with all four kinds of lacing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phonolith.llm import words as W

FRAME, RATE, LACED, CLUSTER_BLOCKS = 192, 8000, 8, 16
# fixed values: element ids of the Matroska specification (RFC 9559)
EBML, SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, FRAME_DURATION, MUXING_APP, WRITING_APP = 0x4282, 0x23E383, 0x4D80, 0x5741
_APP = b"phonolith"
_MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES, EBML, SEGMENT}


class Packet(NamedTuple):
    """A frame: its track, timestamp in ms, place and length in the file, and the place of its cluster."""

    track: int
    timestamp: float
    offset: int
    length: int
    cluster: int


class Media(NamedTuple):
    """Packets in file order, codec by track, (time, track, cluster place) of the cues, and what was wrong, if anything."""

    packets: list[Packet]
    codecs: dict[int, str]
    cues: list[tuple[int, int, int]]
    error: str | None


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer of the least (or the given) width."""
    width = width or max(1, (n + 1).bit_length() // 7 + ((n + 1).bit_length() % 7 > 0))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def _uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], at: int, number: int) -> bytes:
    """A SimpleBlock at a time relative to its cluster; the kind of lacing takes turns (fixed only for equal frames)."""
    kind = 0 if len(frames) == 1 else (2, 3, 1)[number % 3]
    if kind == 2 and len({*map(len, frames)}) > 1:
        kind = 3
    out = vint(1) + struct.pack(">hB", at, 0x80 | kind << 1)
    if kind:
        out += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if kind == 1:
            out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif kind == 3:
            out += vint(sizes[0]) + b"".join(vint(b - a + (1 << 13) - 1, 2) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return element(SIMPLE_BLOCK, out + b"".join(frames))


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """Matroska bytes that hold the payload as 8-bit samples; the last frame may be shorter."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    ms = frame * 1000 // RATE
    audio = element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FRAME_DURATION, ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    apps = element(MUXING_APP, _APP) + element(WRITING_APP, _APP)
    body = element(INFO, _uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + apps) + element(TRACKS, element(ENTRY, track))
    parts, cues, size = [body], [], len(body)
    for c in range(0, len(frames), LACED * CLUSTER_BLOCKS):
        own = frames[c : c + LACED * CLUSTER_BLOCKS]
        blocks = [_block(own[b : b + LACED], b * ms, (c + b) // LACED) for b in range(0, len(own), LACED)]
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c * ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, size))))
        parts.append(element(CLUSTER, _uint(TIMESTAMP, c * ms) + b"".join(blocks)))
        size += len(parts[-1])
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


def _read_vint(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """Value, place after it, and whether all its bits are set (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & (1 << 7 * width) - 1
    return value if keep else bare, at + width, bare == (1 << 7 * width) - 1


def _elements(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """Id, own place, and the range of the content of each child; an unknown size lasts to the next top element."""
    while at < end:
        place = at
        name, at, _ = _read_vint(data, at, True)
        if parent == CLUSTER and name in _TOP:
            return
        size, at, unknown = _read_vint(data, at, False)
        stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {name:x} at {place} ends beyond its parent")
        yield name, place, at, stop
        if unknown and name == CLUSTER:
            inner = at
            while inner < end:
                child, after, _ = _read_vint(data, inner, True)
                if child in _TOP:
                    break
                n, after, _ = _read_vint(data, after, False)
                inner = after + n
            stop = inner
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Track, relative time and (place, length) of each frame of a block."""
    track, at, _ = _read_vint(data, at, False)
    time, flags = struct.unpack_from(">hB", data, at)
    at, kind = at + 3, flags >> 1 & 3
    if at > end or (kind and at == end):
        raise ValueError(f"a block ends in its head at {at}")
    if not kind:
        return track, time, [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        while len(sizes) < count - 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and count > 1:
        n, at, _ = _read_vint(data, at, False)
        sizes.append(n)
        while len(sizes) < count - 1:
            start = at
            n, at, _ = _read_vint(data, at, False)
            sizes.append(sizes[-1] + n - ((1 << 7 * (at - start) - 1) - 1))
    if kind == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing doesn't divide the block at {at}")
        sizes = [(end - at) // count] * count
    else:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing ends beyond its block at {at}")
    places = at + np.concatenate([[0], np.cumsum(sizes)])
    return track, time, [(int(p), n) for p, n in zip(places, sizes, strict=False)]


def parse(data: bytes) -> Media:
    """Packets, codecs and cues of Matroska bytes. What is broken ends the reading; what came before it is returned."""
    packets: list[Packet] = []
    codecs: dict[int, str] = {}
    cues: list[tuple[int, int, int]] = []
    steps: dict[int, int] = {}
    scale, base = 1_000_000, 0

    def number(a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError(f"an integer of {b - a} bytes at {a}")
        return int.from_bytes(data[a:b], "big")

    def walk(at: int, end: int, parent: int, state: dict) -> None:
        nonlocal scale, base
        for name, place, a, b in _elements(data, at, end, parent):
            if name == SEGMENT:
                base = a
            if name in _MASTERS:
                inner = {"cluster": place - base, "time": 0} if name == CLUSTER else {} if name in (ENTRY, CUE_POINT) else state
                walk(a, b, name, inner)
                if name == ENTRY:
                    codecs[inner.get("number", 0)] = inner.get("codec", "")
                    steps[inner.get("number", 0)] = inner.get("step", 0)
                elif name == CUE_POINT:
                    cues.extend((inner.get("cue", 0), t, c) for t, c in zip(inner.get("cue_tracks", []), inner.get("clusters", []), strict=False))
            elif name == SCALE:
                scale = number(a, b)
            elif name == TIMESTAMP:
                state["time"] = number(a, b)
            elif name == TRACK_NUMBER:
                state["number"] = number(a, b)
            elif name == CODEC:
                state["codec"] = data[a:b].decode("utf-8", "replace")
            elif name == FRAME_DURATION:
                state["step"] = number(a, b)
            elif name == CUE_TIME:
                state["cue"] = number(a, b)
            elif name == CUE_TRACK:
                state.setdefault("cue_tracks", []).append(number(a, b))
            elif name == CUE_CLUSTER:
                state.setdefault("clusters", []).append(number(a, b))
            elif name in (SIMPLE_BLOCK, BLOCK):
                track, time, frames = _frames(data, a, b)
                stamp = (state.get("time", 0) + time) * scale / 1e6
                packets.extend(Packet(track, stamp + i * steps.get(track, 0) / 1e6, p, n, state.get("cluster", 0)) for i, (p, n) in enumerate(frames))

    try:
        walk(0, len(data), 0, {})
    except (ValueError, IndexError, OverflowError, struct.error, RecursionError) as e:
        return Media(packets, codecs, cues, str(e) or type(e).__name__)
    return Media(packets, codecs, cues, None)


def mux_texts(documents: DataFrame, unit: int = FRAME) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as UTF-8, with spaces up to a positive multiple of ``unit``, as Matroska.

    Null counts as empty (one unit of spaces). Equal texts have equal media. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offsets = W.raw(part.column("text"))
                blob = data.tobytes()
                texts = [blob[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                media = [mux(t + b" " * (-len(t) % unit if t else unit), unit) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_bytes bigint, media binary")


def feature_of(samples: np.ndarray, media: Media) -> str:
    """Features of a track of 8-bit samples: packets, length, level, spread and zero crossings around the mean."""
    if not len(samples):
        return "packets=0"
    centred = samples.astype(np.int64) * len(samples) - int(samples.sum(dtype=np.int64))
    crossings = int(np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0)))
    return f"packets={len(media.packets)};ms={media.packets[-1].timestamp + media.packets[-1].length * 1000 / RATE:g};mean={samples.mean():.6f};std={samples.std():.6f};crossings={crossings};cues={len(media.cues)}"


_PACKETS = "array<struct<track:bigint,timestamp:double,offset:bigint,length:bigint,cluster:bigint>>"


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The table with ``packets``, ``payload`` (the packets' bytes), ``feature`` and ``error`` of its media column.

    Columns of these names are replaced. Null media has no packets and error "no media"; broken media has the packets
    before the break and says where it is.
    """
    new = ["packets", "payload", "feature", "error"]
    kept = media.drop(*new)
    kind = pa.list_(pa.struct([("track", pa.int64()), ("timestamp", pa.float64()), ("offset", pa.int64()), ("length", pa.int64()), ("cluster", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, column):
                packets, payloads, features, errors = [], [], [], []
                for data in part.column(column).to_pylist():
                    found = parse(data) if data is not None else Media([], {}, [], "no media")
                    payload = b"".join([data[p.offset : p.offset + p.length] for p in found.packets])
                    packets.append([p._asdict() for p in found.packets])
                    payloads.append(payload)
                    features.append(feature_of(np.frombuffer(payload, np.uint8), found))
                    errors.append(found.error)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packets, kind), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())], [*part.schema.names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"packets {_PACKETS}, payload binary, feature string, error string"])
    return kept.mapInArrow(rows, schema)
