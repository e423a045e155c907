"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A text is cut before every run of ASCII white space. No rule of the tokenizers at hand joins what stands before such a
place with what follows it, so the ids of the pieces, one after the other, are the ids of the text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from phonolith.llm import words as W

_PIECES = 2_000_000  # pieces that a process remembers, at about 30 bytes each
_SHORT = 64  # bytes of a piece that is worth remembering


class Encoder:
    """Encodes Arrow string arrays with a tokenizer file. One for each process and file: see ``encoder()``.

    Known pieces are kept in NumPy arrays, under two independent 64-bit hashes of their bytes, in order of the first.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.first, self.second, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids, self.ends = np.empty(1 << 16, self.kind), np.zeros(1, np.int32)

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Encode pieces; their numbers among the ids."""
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(encoded), self.kind)
        used, before = self.ends[-1], len(self.ends) - 1
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used // 4 + 2 * len(flat), self.kind)])
        self.ids[used : used + len(flat)] = flat
        self.ends = np.concatenate([self.ends, used + np.cumsum(np.fromiter(map(len, encoded), np.int32, len(encoded)), dtype=np.int32)])
        return (before + np.arange(len(pieces))).astype(np.int32)

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The number of each of the distinct pieces; new ones are encoded, short ones remembered."""
        data, offsets = W.raw(distinct)
        pieces = W.Words(data, offsets, offsets[:-1], offsets[1:], np.empty(0, np.int64))
        first, second = W.word_hashes(pieces), W.word_hashes(pieces, 1)
        at = np.minimum(np.searchsorted(self.first, first), max(len(self.first) - 1, 0))
        known = (self.first[at] == first) & (self.second[at] == second) if len(self.first) else np.zeros(len(first), bool)
        out = np.empty(len(first), np.int32)
        out[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._add(distinct.take(pa.array(new)).to_pylist())
            keep = new[np.diff(offsets)[new] <= _SHORT]
            keep = keep[np.argsort(first[keep], kind="stable")]
            place = np.searchsorted(self.first, first[keep])
            self.first, self.second, self.number = (np.insert(old, place, more) for old, more in ((self.first, first[keep]), (self.second, second[keep]), (self.number, out[keep])))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text; null counts as empty."""
        data, offsets = W.raw(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        space = W._SEPARATOR[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        if len(self.ends) > _PIECES:
            self._clear()
        number = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        starts, lengths = self.ends[number], self.ends[number + 1] - self.ends[number]
        to = np.cumsum(lengths, dtype=np.int64) - lengths
        ids = self.ids[np.repeat(starts - to, lengths) + np.arange(lengths.sum())].astype(np.uint32)
        total = np.append(to, lengths.sum())[np.searchsorted(cuts, offsets)]
        return ids, np.diff(total)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after those of each text, and the new offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    out = np.full(offsets[-1], end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = ids
    return out, offsets
