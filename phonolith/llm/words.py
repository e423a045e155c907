"""Words of Arrow string batches as NumPy arrays, and hashes of them and of their n-grams.

A word is a run of bytes other than the six ASCII separators (space, tab to carriage return); UTF-8 never uses those
bytes inside a longer code point, so whole texts are cut without decoding them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Words:
    """data: all bytes; offsets: of the texts in data; starts, ends: of the words in data; doc: text number of each word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of words before each text, and of all words."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


@lru_cache
def lean() -> None:
    """Have arrays of over 1 MB of this worker go back to the system when they are freed (where the C library can).

    Without it, the allocator keeps the largest sizes that a worker ever had, also while the worker is idle.
    """
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes.astype(np.int64)) - sizes) // most
    cuts = np.flatnonzero(np.diff(run, prepend=-1))
    for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if not n or buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(texts: pa.Array) -> Words:
    """The words of each text."""
    data, offsets = raw(texts)
    inside = ~_SEPARATOR[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before[edge], after[edge - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE, _LANES_MOST = 8, 8
_KEEP = np.array([(1 << 8 * r) - 1 for r in range(8)] + [(1 << 64) - 1], np.uint64)  # the first r bytes of a lane


def word_hashes(words: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; other salts give independent ones.

    Lanes of 8 bytes are mixed one after the other, starting from the word's length; words of over 64 bytes have XXH64.
    """
    lengths = words.ends - words.starts
    out = mix(lengths.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x5851F42D4C957F2D * (salt + 1) % (1 << 64)))
    padded = np.append(words.data, np.zeros(_LANE, np.uint8))
    lanes = np.lib.stride_tricks.as_strided(padded, (len(words.data) + 1, _LANE), (1, 1))
    left = np.flatnonzero(lengths <= _LANE * _LANES_MOST)
    at = 0
    while len(left):
        lane = lanes[words.starts[left] + at].view("<u8").ravel() & _KEEP[np.minimum(lengths[left] - at, _LANE)]
        out[left] = mix((out[left] ^ lane) + np.uint64(_BASE))
        at += _LANE
        left = left[lengths[left] > at]
    blob = memoryview(np.ascontiguousarray(words.data))
    for i in np.flatnonzero(lengths > _LANE * _LANES_MOST).tolist():
        out[i] = xxhash.xxh64_intdigest(blob[words.starts[i] : words.ends[i]], salt)
    return out


def numbered(words: Words, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each of the words ``at``: equal words, and only those, have the same. hashes: of all words.

    Each word is compared with the first one of its hash, byte by byte.
    """
    _, first, number = np.unique(hashes[at], return_index=True, return_inverse=True)
    alike = at[first][number]
    lengths = words.ends[at] - words.starts[at]
    same = np.array_equal(lengths, words.ends[alike] - words.starts[alike])
    if same:
        to = np.cumsum(lengths) - lengths
        step = np.arange(lengths.sum())
        same = np.array_equal(words.data[np.repeat(words.starts[at] - to, lengths) + step], words.data[np.repeat(words.starts[alike] - to, lengths) + step])
    if not same:
        blob, known = words.data.tobytes(), {}
        number = np.array([known.setdefault(blob[words.starts[i] : words.ends[i]], len(known)) for i in at.tolist()], np.int64)
    return number


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; runs that cross texts are there too and must be masked by the caller."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : n + j]
    return mix(out)


def gram_inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of k words at each place stays in one text."""
    return doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.empty(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : len(x) - w + 1 + w - size]) if size < w else out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:n]) > 0


def joined(words: Words, keep: np.ndarray) -> list[str]:
    """For each text, its kept words joined by one space."""
    starts, ends, doc = words.starts[keep], words.ends[keep], words.doc[keep]
    if not len(starts):
        return [""] * (len(words.offsets) - 1)
    lengths = ends - starts + 1
    to = np.cumsum(lengths) - lengths
    index = np.repeat(starts - to, lengths) + np.arange(lengths.sum())
    out = words.data[np.minimum(index, len(words.data) - 1)]
    out[to + lengths - 1] = 32
    first = np.searchsorted(doc, np.arange(len(words.offsets)))
    place = np.append(to, lengths.sum())[first]
    blob = out.tobytes()
    return [blob[a : max(a, b - 1)].decode("utf-8") for a, b in zip(place[:-1], place[1:], strict=True)]
