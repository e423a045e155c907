"""Batched alignments against plain dynamic programs, one pair at a time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from phonolith.operators import alignment as A
from phonolith.operators import kernels as K

SOUNDS = "ɪ iː s t d θ v w ɹ ə ʊ ŋ ɡ i ɾ p b".split()


def plain_walk(rows, columns, diagonal, skip_row, skip_column):
    best = {(0, 0): (0.0, None)}
    for i in range(rows + 1):
        for j in range(columns + 1):
            ways = []
            if i and j:
                ways.append((best[i - 1, j - 1][0] + diagonal(i - 1, j - 1), 0))
            if i:
                ways.append((best[i - 1, j][0] + skip_row(i - 1), 1))
            if j:
                ways.append((best[i, j - 1][0] + skip_column, 2))
            if ways:
                best[i, j] = min(ways)
    path, i, j = [], rows, columns
    while i or j:
        s = best[i, j][1]
        i, j = i - (s != 2), j - (s != 1)
        path.append((s, i, j))
    return best[rows, columns][0], path[::-1]


def plain_align(e, h, flags=None, variants=None):
    flags, variants = flags or [False] * len(e), variants or [(frozenset(), False)] * len(e)
    out = []
    for s, i, j in plain_walk(len(e), len(h), lambda i, j: K.substitution_cost(e[i], h[j], flags[i], variants[i][0]), lambda i: K.VARIANT if variants[i][1] else K.INDEL, K.INDEL)[1]:
        if s == 0:
            out.append(("match" if K.acceptable(e[i], h[j], flags[i], variants[i][0]) else "sub", e[i], h[j], i, j))
        elif s == 1:
            out.append(("match" if variants[i][1] else "del", e[i], None, i, None))
        else:
            out.append(("ins", None, h[j], None, j))
    return out


def plain_words(expected, heard, flags):
    def cost(i, j):
        own = [flags[i]] * len(expected[i])
        ops = [K.Op(*o) for o in plain_align(expected[i], heard[j], own)]
        return K.edit_cost(ops, own) / max(len(expected[i]), len(heard[j]), 1)

    out = [None] * len(expected)
    for s, i, j in plain_walk(len(expected), len(heard), cost, lambda i: K.WORD_GAP, K.WORD_GAP)[1]:
        if s == 0:
            out[i] = list(heard[j])
    return out


def sequences_of(rng, n, most):
    return [[rng.choice(SOUNDS) for _ in range(rng.randrange(most))] for _ in range(n)]


def as_tuples(ops):
    return [(o.kind, o.expected, o.heard, o.exp_pos, o.heard_pos) for o in ops]


def test_lists_of_many_lengths_with_flags_and_variants():
    rng = random.Random(1)
    e, h = sequences_of(rng, 150, 30), sequences_of(rng, 150, 30)
    flags = [rng.choice([None, [rng.random() < 0.5 for _ in x]]) for x in e]
    variants = [rng.choice([None, [(frozenset(rng.sample(SOUNDS, 2)) if rng.random() < 0.2 else frozenset(), rng.random() < 0.2) for _ in x]]) for x in e]
    assert [as_tuples(o) for o in A.align_many(e, h, flags, variants)] == [plain_align(*x) for x in zip(e, h, flags, variants, strict=True)]


@pytest.mark.parametrize("cells, table", [(A.CELLS, A.TABLE), (500, A.TABLE), (500, 20)])
def test_columns_of_any_chunking(monkeypatch, cells, table):
    monkeypatch.setattr(A, "CELLS", cells)
    monkeypatch.setattr(A, "TABLE", table)
    rng = random.Random(2)
    e, h = sequences_of(rng, 80, 20), sequences_of(rng, 80, 20)
    flags = [rng.choice([None, [rng.random() < 0.5 for _ in x]]) for x in e]
    e[3], h[4], h[5], e[5] = None, None, [], []
    kind = pa.list_(pa.string())
    whole = [pa.array(e, kind), pa.array(h, kind), pa.array(flags, pa.list_(pa.bool_()))]
    for cut in (0, 7):  # a slice has offsets of its own
        got = A.align_arrays(*(x[cut:] for x in whole)).to_pylist()
        want = [None if a is None or b is None else plain_align(a, b, f) for a, b, f in zip(e, h, flags, strict=True)][cut:]
        assert [None if x is None else [tuple(o.values()) for o in x] for x in got] == want


def test_empty_batches():
    none = pa.array([], pa.list_(pa.string()))
    assert A.align_arrays(none, none).to_pylist() == [] and A.align_many([], []) == [] and A.align_words_many([], [], []) == []
    assert A.align_arrays(pa.array([[]], pa.list_(pa.string())), pa.array([[]], pa.list_(pa.string()))).to_pylist() == [[]]


def test_words_cost_by_the_longer_one():
    # one sound against three: two added sounds of three are less than a skipped and an extra word
    assert A.align_words_many([[["s"]]], [[["s", "t", "ɹ"]]], [[False]]) == [[["s", "t", "ɹ"]]]
    assert A.align_words_many([[["s"]]], [[["p", "t", "ɹ", "iː"]]], [[False]]) == [[["p", "t", "ɹ", "iː"]]]
    assert A.align_words_many([[["s"], ["t"]]], [[]], [[False, False]]) == [[None, None]]


def test_words_of_many_texts():
    rng = random.Random(3)
    e = [sequences_of(rng, rng.randrange(7), 5) for _ in range(60)]
    h = [sequences_of(rng, rng.randrange(7), 9) for _ in range(60)]
    flags = [[rng.random() < 0.3 for _ in x] for x in e]
    assert A.align_words_many(e, h, flags) == [plain_words(*x) for x in zip(e, h, flags, strict=True)]


def test_batches_are_ten_times_as_fast():
    rng = random.Random(4)
    e, h = ([[rng.choice(SOUNDS) for _ in range(rng.randrange(20, 50))] for _ in range(4000)] for _ in range(2))
    kind = pa.list_(pa.string())
    one, two = pa.array(e, kind), pa.array(h, kind)
    A.align_arrays(one[:100], two[:100])
    started = time.process_time()
    A.align_arrays(one, two)
    batched = (time.process_time() - started) / 4000
    started = time.process_time()
    for a, b in zip(e[:60], h[:60], strict=True):
        plain_align(a, b)
    assert (time.process_time() - started) / 60 > 10 * batched


def test_best_costs_agree_with_the_paths():
    rng = np.random.default_rng(5)
    a, b = (A.Lists.of([rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(50)]) for _ in range(2))
    table = rng.integers(0, 3, (6, 6)).astype(float)
    costs, alone = A.best_costs(a.sizes, b.sizes, A.from_table(a, b, table, np.ones(6)), 1.0), 1.0
    for k in range(50):
        x, y = a.values[a.offsets[k] : a.offsets[k + 1]], b.values[b.offsets[k] : b.offsets[k + 1]]
        assert costs[k] == plain_walk(len(x), len(y), lambda i, j: table[x[i], y[j]], lambda i: alone, 1.0)[0]  # noqa: B023
