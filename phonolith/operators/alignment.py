"""Alignments of many pairs of sequences at once (no Spark): all cells of an anti-diagonal of all pairs in one step.

Pairs are put in buckets by their lengths. Costs come from a small table of the symbols that occur, so the sweep itself only
adds and compares numbers; the steps taken are kept in two bits for each cell, and the ways back are walked for a whole bucket
at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phonolith.operators import kernels as K

#: Cells of a bucket's chunk, pairs' lengths that share a bucket, and entries of a cost table.
CELLS, NEAR, TABLE = 1 << 23, 8, 1 << 21
BOTH, ROW, COLUMN = 0, 1, 2
OP = pa.struct([("kind", pa.string()), ("expected", pa.string()), ("heard", pa.string()), ("exp_pos", pa.int32()), ("heard_pos", pa.int32())])


class Lists:
    """Sequences of codes in a row: values, and where each starts (one more entry at the end)."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets
        self.sizes = np.diff(offsets)

    @classmethod
    def of(cls, rows: Sequence[Sequence[int]]) -> Lists:
        sizes = [len(r) for r in rows]
        return cls(np.array([x for r in rows for x in r], np.int64), np.append(0, np.cumsum(sizes)).astype(np.int64))

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """Some sequences side by side, filled up with the code 0."""
        at = self.offsets[which][:, None] + np.arange(width)
        inside = np.arange(width) < self.sizes[which][:, None]
        return np.where(inside, self.values[np.minimum(at, max(len(self.values) - 1, 0))], 0) if len(self.values) else np.zeros(at.shape, np.int64)


#: Costs of a chunk of pairs: (pairs, rows, columns) to a function of (diagonal, first row, last row), and the cost of each row alone.
Costs = Callable[[np.ndarray, int, int], tuple[Callable[[int, int, int], np.ndarray], np.ndarray]]


def from_table(expected: Lists, heard: Lists, table: np.ndarray, alone: np.ndarray) -> Costs:
    """Costs of symbol pairs by their codes."""

    def chunk(pairs: np.ndarray, n: int, m: int):
        e, h = expected.padded(pairs, n), heard.padded(pairs, m)
        return lambda d, a, b: table[e[:, a - 1 : b], h[:, d - b - 1 : d - a][:, ::-1]], alone[e]

    return chunk


def _chunks(n: np.ndarray, m: np.ndarray):
    """Pairs of like lengths, so many that a chunk's traces stay small."""
    key = (n // NEAR) << 32 | (m // NEAR)
    order = np.argsort(key, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
        rows, columns = int(n[own].max()), int(m[own].max())
        size = max(1, CELLS // ((rows + 1) * (rows + columns + 1)))
        for at in range(0, len(own), size):
            yield own[at : at + size], rows, columns


def _sweep(n: np.ndarray, m: np.ndarray, rows: int, columns: int, diagonal, alone: np.ndarray, added: float, traced: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The cost of each pair's best path, and the packed steps: those of diagonal d in bits 2 * (d % 4) of layer d // 4."""
    pairs = len(n)
    before = last = np.zeros((pairs, rows + 1))
    out = np.zeros(pairs)
    trace = np.zeros(((rows + columns) // 4 + 1, pairs, rows + 1), np.uint8) if traced else None
    for d in range(1, rows + columns + 1):
        here = np.empty_like(last)
        step = np.zeros((pairs, rows + 1), np.uint8)
        if d <= columns:
            here[:, 0], step[:, 0] = last[:, 0] + added, COLUMN
        if d <= rows:
            here[:, d], step[:, d] = last[:, d - 1] + alone[:, d - 1], ROW
        a, b = max(1, d - columns), min(d - 1, rows)
        if a <= b:
            both, row, column = before[:, a - 1 : b] + diagonal(d, a, b), last[:, a - 1 : b] + alone[:, a - 1 : b], last[:, a : b + 1] + added
            # ties: both, then the row alone, then the column alone
            worse = np.where(row <= column, ROW, COLUMN).astype(np.uint8)
            other = np.minimum(row, column)
            step[:, a : b + 1] = np.where(both <= other, BOTH, worse)
            here[:, a : b + 1] = np.minimum(both, other)
        if traced:
            trace[d // 4] |= step << np.uint8(2 * (d % 4))
        ended = np.flatnonzero(n + m == d)
        out[ended] = here[ended, n[ended]]
        before, last = last, here
    return out, trace


def best_costs(n: np.ndarray, m: np.ndarray, costs: Costs, added: float) -> np.ndarray:
    """The cost of the cheapest way through each pair's grid."""
    out = np.zeros(len(n))
    for own, rows, columns in _chunks(n, m):
        out[own] = _sweep(n[own], m[own], rows, columns, *costs(own, rows, columns), added, False)[0]
    return out


def best_paths(n: np.ndarray, m: np.ndarray, costs: Costs, added: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest ways, one after the other: where each starts (one more entry at the end), and of each step its kind, row and
    column."""
    found, sizes = [], np.zeros(len(n), np.int64)
    for own, rows, columns in _chunks(n, m):
        trace = _sweep(n[own], m[own], rows, columns, *costs(own, rows, columns), added, True)[1]
        i, j, who = n[own].copy(), m[own].copy(), np.flatnonzero(n[own] + m[own])
        steps = []
        while len(who):
            d = i[who] + j[who]
            s = trace[d // 4, who, i[who]] >> (2 * (d % 4)).astype(np.uint8) & np.uint8(3)
            i[who] -= s != COLUMN
            j[who] -= s != ROW
            steps.append((own[who], s, i[who], j[who]))
            sizes[own[who]] += 1
            who = who[i[who] + j[who] > 0]
        found.append(steps)
    offsets = np.append(0, np.cumsum(sizes))
    kind, row, column = np.zeros(offsets[-1], np.uint8), np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
    for steps in found:
        for k, (pair, s, i, j) in enumerate(steps):
            at = offsets[pair + 1] - 1 - k
            kind[at], row[at], column[at] = s, i, j
    return offsets, kind, row, column


# --- sounds --------------------------------------------------------------------------------------------------------------

_cost = lru_cache(1 << 18)(K.substitution_cost)
_fine = lru_cache(1 << 18)(K.acceptable)


def _tables(expected: Sequence[tuple], heard: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the symbols (sound, in a function word, other ways to say it, whether it may be left out) and the heard sounds: costs,
    what counts as a match, and the cost of leaving each symbol out."""
    cost = np.array([[_cost(e, h, f, x) for h in heard] for e, f, x, _ in expected], np.float64).reshape(len(expected), len(heard))
    fine = np.array([[_fine(e, h, f, x) for h in heard] for e, f, x, _ in expected], bool).reshape(len(expected), len(heard))
    return cost, fine, np.array([K.VARIANT if o else K.INDEL for *_, o in expected])


def align_many(expected: Sequence[Sequence[str]], heard: Sequence[Sequence[str]], flags: Sequence[Sequence[bool] | None] | None = None, variants: Sequence[Sequence[tuple[frozenset, bool]] | None] | None = None) -> list[list[K.Op]]:
    """``kernels.align()`` of many pairs. Ties: both, then deletion, then insertion."""
    symbols, sounds = {}, {}
    none, no_flags, no_variants = (frozenset(), False), [None] * len(expected), [None] * len(expected)
    rows = []
    for e, f, v in zip(expected, flags or no_flags, variants or no_variants, strict=True):
        rows.append([symbols.setdefault((p, bool(f and f[k]), *(v[k] if v else none)), len(symbols)) for k, p in enumerate(e)])
    columns = [[sounds.setdefault(p, len(sounds)) for p in h] for h in heard]
    if len(symbols) * len(sounds) > TABLE and len(rows) > 1:
        half = len(rows) // 2
        parts = [align_many(expected[s], heard[s], flags and flags[s], variants and variants[s]) for s in (slice(half), slice(half, None))]
        return parts[0] + parts[1]
    keys, names = list(symbols), list(sounds)
    cost, fine, alone = _tables(keys, names)
    a, b = Lists.of(rows), Lists.of(columns)
    offsets, kind, row, column = best_paths(a.sizes, b.sizes, from_table(a, b, cost, alone), K.INDEL)
    out = []
    for k in range(len(rows)):
        e, h, ops = expected[k], heard[k], []
        for s, i, j in zip(*(x[offsets[k] : offsets[k + 1]].tolist() for x in (kind, row, column)), strict=True):
            if s == BOTH:
                ops.append(K.Op("match" if fine[rows[k][i], columns[k][j]] else "sub", e[i], h[j], i, j))
            elif s == ROW:
                ops.append(K.Op("match" if keys[rows[k][i]][3] else "del", e[i], None, i, None))
            else:
                ops.append(K.Op("ins", None, h[j], None, j))
        out.append(ops)
    return out


def _lists(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array and the offsets of its rows; null rows are empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return array.flatten(), np.append(0, np.cumsum(sizes))


def _codes(*values: pa.Array) -> tuple[list[np.ndarray], list[str | None]]:
    """The same numbers for the same strings of several arrays."""
    every = pa.concat_arrays([v.cast(pa.string()) for v in values]).dictionary_encode("encode")
    codes, ends = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(v) for v in values])
    return np.split(codes, ends[:-1]), every.dictionary.to_pylist()


def align_arrays(expected: pa.Array, heard: pa.Array, flags: pa.Array | None = None) -> pa.Array:
    """Edit operations of columns of sequences; null where one is null. flags: which expected sounds are in function words."""
    (e, e_at), (h, h_at) = _lists(expected), _lists(heard)
    (own, said), names = _codes(e, h)
    marks = np.zeros(len(own), np.int64)
    if flags is not None:
        f, f_at = _lists(flags)
        sizes = np.diff(f_at)
        full = np.repeat(sizes == np.diff(e_at), np.diff(e_at))  # rows without flags have none
        marks[full] = pc.fill_null(f, False).to_numpy(zero_copy_only=False)[np.repeat(sizes == np.diff(e_at), sizes)]
    symbols, own = np.unique(own * 2 + marks, return_inverse=True)
    sounds, said = np.unique(said, return_inverse=True)
    if len(symbols) * len(sounds) > TABLE and len(expected) > 1:
        half = len(expected) // 2
        return pa.concat_arrays([align_arrays(expected[s], heard[s], flags[s] if flags is not None else None) for s in (slice(0, half), slice(half, None))])
    cost, fine, alone = _tables([(names[s // 2], bool(s % 2), frozenset(), False) for s in symbols], [names[s] for s in sounds])
    offsets, kind, row, column = best_paths(np.diff(e_at), np.diff(h_at), from_table(Lists(own, e_at), Lists(said, h_at), cost, alone), K.INDEL)
    pair = np.repeat(np.arange(len(expected)), np.diff(offsets))
    left, right = np.where(kind != COLUMN, e_at[pair] + row, -1), np.where(kind != ROW, h_at[pair] + column, -1)
    both = kind == BOTH
    name = np.where(kind == ROW, 0, 1)
    name[both] = np.where(fine[own[left[both]], said[right[both]]], 2, 3)
    pick = lambda values, at: values.cast(pa.string()).take(pa.array(at, mask=at < 0))
    place = lambda at, whole: pa.array(at.astype(np.int32), mask=whole < 0)
    ops = pa.StructArray.from_arrays([pa.array(["del", "ins", "match", "sub"]).take(pa.array(name)), pick(e, left), pick(h, right), place(row, left), place(column, right)], fields=list(OP))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ops, mask=pc.or_(expected.is_null(), heard.is_null()))


def align_words_many(expected: Sequence[Sequence[Sequence[str]]], heard: Sequence[Sequence[Sequence[str]]], flags: Sequence[Sequence[bool]]) -> list[list[list[str] | None]]:
    """The heard word of each expected word of many texts, None if it was skipped; ties: match, then skip, then extra word.

    Two words cost the alignment of their sounds by the longer one's length. Pairs of words that come again are aligned once.
    """
    ours, theirs = {}, {}
    rows = [[ours.setdefault((tuple(w), bool(f)), len(ours)) for w, f in zip(e, fs, strict=True)] for e, fs in zip(expected, flags, strict=True)]
    columns = [[theirs.setdefault(tuple(w), len(theirs)) for w in h] for h in heard]
    a, b = Lists.of(rows), Lists.of(columns)
    # every word of a text with every heard word of it
    pair_sizes = a.sizes * b.sizes
    text = np.repeat(np.arange(len(rows)), pair_sizes)
    place = np.arange(pair_sizes.sum()) - np.repeat(np.cumsum(pair_sizes) - pair_sizes, pair_sizes)
    i, j = (place // np.maximum(b.sizes[text], 1), place % np.maximum(b.sizes[text], 1))
    asked, which = np.unique(a.values[a.offsets[text] + i] * max(len(theirs), 1) + b.values[b.offsets[text] + j], return_inverse=True) if len(text) else (np.empty(0, np.int64), np.empty(0, np.int64))
    words, said = list(ours), list(theirs)
    cost = _word_costs([words[k // len(said)] for k in asked], [said[k % len(said)] for k in asked])
    starts = np.append(0, np.cumsum(pair_sizes))

    def chunk(pairs: np.ndarray, n: int, m: int):
        wide = max(m, 2)  # steps of wide - 1 walk an anti-diagonal of the flattened grid
        known = np.zeros((len(pairs), n, wide))
        for k, p in enumerate(pairs.tolist()):
            known[k, : a.sizes[p], : b.sizes[p]] = cost[which[starts[p] : starts[p + 1]]].reshape(a.sizes[p], b.sizes[p])
        flat = known.reshape(len(pairs), -1)
        return lambda d, x, y: flat[:, (x - 1) * wide + d - x - 1 :: wide - 1][:, : y - x + 1], np.full((len(pairs), n), K.WORD_GAP)

    offsets, kind, row, column = best_paths(a.sizes, b.sizes, chunk, K.WORD_GAP)
    out: list[list[list[str] | None]] = [[None] * len(e) for e in expected]
    pair = np.repeat(np.arange(len(rows)), np.diff(offsets))
    for p, x, y in zip(*(v[kind == BOTH].tolist() for v in (pair, row, column)), strict=True):
        out[p][x] = list(heard[p][y])
    return out


def _word_costs(expected: Sequence[tuple[tuple[str, ...], bool]], heard: Sequence[tuple[str, ...]]) -> np.ndarray:
    """The cost of each pair of words: that of their sounds by the number of sounds of the longer one."""
    symbols, sounds = {}, {}
    a = Lists.of([[symbols.setdefault((p, f, frozenset(), False), len(symbols)) for p in w] for w, f in expected])
    b = Lists.of([[sounds.setdefault(p, len(sounds)) for p in w] for w in heard])
    if len(symbols) * len(sounds) > TABLE and len(expected) > 1:
        half = len(expected) // 2
        return np.concatenate([_word_costs(expected[:half], heard[:half]), _word_costs(expected[half:], heard[half:])])
    cost, _, alone = _tables(list(symbols), list(sounds))
    return best_costs(a.sizes, b.sizes, from_table(a, b, cost, alone), K.INDEL) / np.maximum(np.maximum(a.sizes, b.sizes), 1)
