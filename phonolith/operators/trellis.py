"""Decoding, CTC alignment and scores of many utterances at once (no Spark).

The frames of all utterances stand in one matrix. Alignment walks the frames once for all utterances of a chunk, with one row of
states for each; scores and leads of rivals are maxima over runs of one long array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

IMPOSSIBLE = -1e30
#: Cells (utterances x frames x states) of a chunk's steps.
CELLS = 1 << 25


class Frames:
    """values: frames x tokens of all utterances; offsets: first frame of each utterance, and their number."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, np.asarray(offsets, np.int64)
        self.sizes = np.diff(self.offsets)

    @classmethod
    def of(cls, matrices: Sequence[np.ndarray], n_vocab: int) -> Frames:
        values = np.concatenate([np.asarray(m, np.float64).reshape(-1, n_vocab) for m in matrices]) if len(matrices) else np.empty((0, n_vocab))
        return cls(values, np.append(0, np.cumsum([len(m) for m in matrices])))

    def dealt(self, of: Sequence[int]) -> Frames:
        """Utterances that share frames: of each the number of its frames here. For alignment and scores; not for decoding."""
        out = Frames(self.values, self.offsets)
        out.offsets, out.sizes = self.offsets[:-1][of], self.sizes[of]
        return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of several runs, one after the other, and where each begins among them; no run may be empty."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum())), begin


def restrict(values: np.ndarray, blocked: Sequence[int]) -> np.ndarray:
    """Frames without the blocked tokens, normalised one by one."""
    if not len(blocked):
        return values
    out = np.array(values, np.float64)
    out[:, list(blocked)] = IMPOSSIBLE
    top = out.max(1, keepdims=True, initial=-np.inf)
    return out - top - np.log(np.exp(out - top).sum(1, keepdims=True))


def greedy_decode(frames: Frames, blank: int, ignore: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(utterance, token, first frame) of each run of the best token; blanks and ignored tokens part runs but are left out."""
    best = frames.values.argmax(1) if len(frames.values) else np.empty(0, np.int64)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[frames.offsets[:-1][frames.sizes > 0]] = True
    at = np.flatnonzero(new & ~np.isin(best, [blank, *ignore]))
    utterance = np.searchsorted(frames.offsets, at, "right") - 1
    return utterance, best[at], at - frames.offsets[utterance]


def forced_align(frames: Frames, targets: Sequence[Sequence[int]], blank: int) -> list[np.ndarray | None]:
    """First and last frame (targets x 2) of each target on the best path through each utterance's CTC graph; None without a path.

    States are blanks and targets in turn; a step to the state after the next is allowed from one target to a different
    one. Ties: stay, then one on, then two on; at the end the last blank before the last target.
    """
    sizes, n = frames.sizes, np.array([2 * len(t) + 1 for t in targets], np.int64)
    out: list[np.ndarray | None] = [None] * len(targets)
    able = np.flatnonzero((sizes > 0) & (n > 1))
    # longest first, so that those still going are a prefix
    order = able[np.lexsort((-n[able], -sizes[able]))]
    at = 0
    while at < len(order):
        cells = int(sizes[order[at]]) * np.maximum.accumulate(n[order[at:]]) * np.arange(1, len(order) - at + 1)
        own = order[at : at + max(1, int(np.searchsorted(cells, CELLS, "right")))]
        at += len(own)
        for u, spans in zip(own.tolist(), _align_chunk(frames, own, [targets[u] for u in own], n[own], blank), strict=True):
            out[u] = spans
    return out


def _align_chunk(frames: Frames, own: np.ndarray, targets: list[Sequence[int]], n: np.ndarray, blank: int) -> list[np.ndarray | None]:
    sizes, base, width = frames.sizes[own], frames.offsets[own], int(n.max())
    label = np.full((len(own), width), blank)
    for k, t in enumerate(targets):
        label[k, 1 : 2 * len(t) : 2] = t
    state = np.arange(width)
    real = state < n[:, None]
    jump = np.zeros((len(own), width), bool)
    jump[:, 3::2] = label[:, 3::2] != label[:, 1:-2:2]
    score = np.full((len(own), width), IMPOSSIBLE)
    first = frames.values[base[:, None], label[:, :2]]
    score[:, :2] = first
    steps = np.zeros((int(sizes.max()), len(own), width), np.uint8)
    for t in range(1, int(sizes.max())):
        going = int(np.searchsorted(-sizes, -t))  # utterances longer than t
        old = score[:going]
        one, two = np.full_like(old, IMPOSSIBLE), np.full_like(old, IMPOSSIBLE)
        one[:, 1:] = old[:, :-1]
        two[:, 2:] = np.where(jump[:going, 2:], old[:, :-2], IMPOSSIBLE)
        step = np.where(one > old, np.uint8(1), np.uint8(0))
        best = np.maximum(old, one)
        step[two > best] = 2
        steps[t, :going] = step
        score[:going] = np.where(real[:going], np.maximum(best, two) + frames.values[(base[:going] + t)[:, None], label[:going]], IMPOSSIBLE)
    rows = np.arange(len(own))
    s = np.where(score[rows, n - 1] >= score[rows, n - 2], n - 1, n - 2)
    fine = score[rows, s] > IMPOSSIBLE / 2
    spans = np.full((len(own), width // 2, 2), -1)
    for t in range(int(sizes.max()) - 1, -1, -1):
        here = rows[: int(np.searchsorted(-sizes, -t))]
        here = here[fine[here]]
        on = here[s[here] % 2 == 1]
        target = s[on] // 2
        spans[on, target, 0] = t
        ends = spans[on, target, 1] < 0
        spans[on[ends], target[ends], 1] = t
        s[here] -= steps[t, here, s[here]]
    found = [spans[k, : len(t)] for k, t in enumerate(targets)]
    return [x if fine[k] and (x >= 0).all() else None for k, x in enumerate(found)]


def gop_scores(frames: Frames, utterance: np.ndarray, tokens: np.ndarray, spans: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Of targets (their utterance, token and span), in their frames: the largest log probability, and the largest lead over the
    best sound (0 at most)."""
    if not len(tokens):
        return np.empty(0), np.empty(0)
    sounds = np.array(frames.values, np.float64)
    sounds[:, blank] = -np.inf
    lead = sounds.max(1)
    sizes = spans[:, 1] - spans[:, 0] + 1
    at, begin = _runs(frames.offsets[utterance] + spans[:, 0], sizes)
    own = frames.values[at, np.repeat(tokens, sizes)]
    return np.maximum.reduceat(own, begin), np.maximum.reduceat(own - lead[at], begin)


def rival_margins(frames: Frames, utterance: np.ndarray, spans: np.ndarray, tokens: np.ndarray, rivals: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The largest lead of a rival over each target in its frames, and the place of that rival (earliest frame, then first)."""
    if not len(tokens):
        return np.empty(0), np.empty(0, np.int64)
    many = np.array([len(r) for r in rivals])
    flat = np.concatenate([np.asarray(r, np.int64) for r in rivals])
    first = np.cumsum(many) - many
    frames_of = spans[:, 1] - spans[:, 0] + 1
    # frame by frame, in each the rivals in turn
    sizes = frames_of * many
    item = np.repeat(np.arange(len(tokens)), sizes)
    place, begin = _runs(np.zeros(len(tokens), np.int64), sizes)
    at = frames.offsets[utterance[item]] + spans[item, 0] + place // many[item]
    lead = frames.values[at, flat[first[item] + place % many[item]]] - frames.values[at, tokens[item]]
    top = np.maximum.reduceat(lead, begin)
    hit = np.flatnonzero(lead == top[item])[::-1]
    best = np.zeros(len(tokens), np.int64)
    best[item[hit]] = place[hit]
    return top, best % many
