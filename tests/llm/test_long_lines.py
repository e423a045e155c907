"""The field over lines of many words."""

import numpy as np
import pyarrow as pa

from phonolith.llm import pii


def test_spans_across_a_cut_are_found():
    for at in range(250, 260):
        words = ["word"] * 600
        words[at : at + 4] = ["call", "(212)", "555-0199", "now"]
        text = " ".join(words)
        start = text.index("(212)")
        assert pii.spans_of(pa.array([text]), pii.default_model()) == [[("phone", start, start + 14, False)]], at


def test_long_lines_are_decoded_as_whole_ones():
    rng = np.random.default_rng(2)
    rows = pii.labelled()
    lines = [" ".join(w for k in rng.integers(0, len(rows), n) for w, _ in rows[k]) for n in (1, 40, 150, 300)]
    shape = [pii.shapes_of(pii.W.split(pa.array([x]))) for x in lines]
    lengths = np.array([*map(len, shape)])
    starts = np.cumsum(lengths) - lengths
    assert lengths.max() > 4 * pii.LINE
    assert (pii._decode_lines(np.concatenate(shape), starts, lengths, pii.default_model()) == pii.decode(np.concatenate(shape), starts, pii.default_model())).all()
