"""Batched decoding, CTC alignment and scores against plain versions, one utterance at a time."""

import itertools

import numpy as np
import pytest

from phonolith.operators import trellis as T


def plain_forced(lp, targets, blank):
    """The best of all paths by the recursion in words: from each state stay, go on, or jump over a blank between unlike targets."""
    if not len(targets) or not len(lp):
        return None
    label = [blank] + [x for t in targets for x in (t, blank)]
    score = {s: (lp[0][label[s]] if s < 2 else T.IMPOSSIBLE) for s in range(len(label))}
    back = []
    for row in lp[1:]:
        new, steps = {}, {}
        for s in range(len(label)):
            options = [score[s], score.get(s - 1, T.IMPOSSIBLE), score[s - 2] if s % 2 and s > 2 and label[s] != label[s - 2] else T.IMPOSSIBLE]
            steps[s] = options.index(max(options))
            new[s] = max(options) + row[label[s]]
        score = new
        back.append(steps)
    s = len(label) - 1 if score[len(label) - 1] >= score[len(label) - 2] else len(label) - 2
    if score[s] <= T.IMPOSSIBLE / 2:
        return None
    path = [s]
    for steps in back[::-1]:
        s -= steps[s]
        path.append(s)
    path = path[::-1]
    spans = [[t for t, s in enumerate(path) if s == 2 * k + 1] for k in range(len(targets))]
    return None if any(not x for x in spans) else [[x[0], x[-1]] for x in spans]


def utterances(seed, n, vocab=6):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        lp = np.log(rng.dirichlet(np.ones(vocab), rng.integers(0, 25)))
        if rng.random() < 0.3:
            lp = np.round(lp)  # ties
        out.append((lp.reshape(-1, vocab), rng.integers(1, vocab, rng.integers(0, 7)).tolist()))
    return out


@pytest.mark.parametrize("cells", [T.CELLS, 200])
def test_alignment_of_any_chunking(monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    own = utterances(1, 120)
    frames = T.Frames.of([lp for lp, _ in own], 6)
    got = T.forced_align(frames, [t for _, t in own], 0)
    assert [None if x is None else x.tolist() for x in got] == [plain_forced(lp.tolist(), t, 0) for lp, t in own]
    assert sum(x is not None for x in got) > 40 and None in [x if x is None else 1 for x in got]


def test_decoding_parts_utterances():
    own = utterances(2, 60)
    frames = T.Frames.of([lp for lp, _ in own], 6)
    got = list(zip(*(x.tolist() for x in T.greedy_decode(frames, 0, (5,))), strict=True))
    want = []
    for u, (lp, _) in enumerate(own):
        best, t = lp.argmax(1).tolist() if len(lp) else [], 0
        for token, run in itertools.groupby(best):
            if token not in (0, 5):
                want.append((u, token, t))
            t += len(list(run))
    assert got == want


def test_scores_and_rivals():
    own = [(lp, t) for lp, t in utterances(3, 80) if plain_forced(lp.tolist(), t, 0)]
    frames = T.Frames.of([lp for lp, _ in own], 6)
    spans = T.forced_align(frames, [t for _, t in own], 0)
    utterance = np.repeat(np.arange(len(own)), [len(t) for _, t in own])
    tokens, flat = np.array([x for _, t in own for x in t]), np.concatenate(spans)
    lpp, lpr = T.gop_scores(frames, utterance, tokens, flat, 0)
    rng = np.random.default_rng(4)
    rivals = [rng.integers(0, 6, rng.integers(1, 4)).tolist() for _ in tokens]
    margin, place = T.rival_margins(frames, utterance, flat, tokens, rivals)
    for k in range(len(tokens)):
        rows = own[utterance[k]][0][flat[k, 0] : flat[k, 1] + 1]
        mine = rows[:, tokens[k]]
        assert lpp[k] == mine.max() and lpr[k] == (mine - rows[:, 1:].max(1)).max()
        lead = rows[:, rivals[k]] - mine[:, None]
        assert margin[k] == lead.max() and place[k] == lead.ravel().argmax() % len(rivals[k])


def test_nothing():
    frames = T.Frames.of([], 6)
    assert T.forced_align(frames, [], 0) == [] and [len(x) for x in T.greedy_decode(frames, 0)] == [0, 0, 0]
    empty = T.Frames.of([np.empty((0, 6))], 6)
    assert T.forced_align(empty, [[1]], 0) == [None] and T.forced_align(empty, [[]], 0) == [None]
    assert T.restrict(np.empty((0, 6)), [1]).shape == (0, 6)
