"""Measures of each expected sound from the frames it was aligned to (no Spark)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from phonolith.operators import kernels as K

SOUNDS = (
    "array<struct<word:int,place:int,n:int,phone:string,kind:string,heard:string,final:boolean,function_word:boolean,lpp:double,lpr:double,"
    "margin_max:double,margin_mean:double,seconds:double,mean_seconds:double,top_other:string>>"
)


def _frames_of(limited: np.ndarray, span: tuple[int, int], target: int, typical: Sequence[str], ids: dict[str, int], blank: int, vocabulary: Sequence[str]) -> dict:
    """The closest typical replacement's lead (largest and mean) and the strongest other token of a sound's frames."""
    frames = limited[span[0] : span[1] + 1]
    out: dict = {}
    known = [ids[c] for c in typical if c in ids]
    if known:
        lead = frames[:, known] - frames[:, [target]]
        best = int(lead.max(axis=0).argmax())
        out = {"margin_max": float(lead[:, best].max()), "margin_mean": float(lead[:, best].mean())}
    mean = frames.mean(axis=0)
    mean[[blank, target]] = -np.inf
    return out | {"top_other": vocabulary[int(mean.argmax())] if np.isfinite(mean.max()) else None}


def sound_measures(words: Sequence[str], raw: Sequence[Sequence[str]], a: dict, vocabulary: Sequence[str], blank: int) -> list[dict]:
    """One row for each expected sound; ``a`` is what ``kernels.analyze()`` returned. Acoustic measures are None for a
    sound without a token or an utterance without an alignment.

    A token lasts until the next one starts; ``mean_seconds`` is the mean of the utterance's tokens.
    """
    phones, word_of, flags, _ = K.prepare_expected(words, raw)
    ids = {t: i for i, t in enumerate(vocabulary)}
    said = {o.exp_pos: o for w in a["words"] for o in w.ops if o.exp_pos is not None}
    spans, out, k = a["spans"], [], 0
    if spans is not None:
        seconds = np.diff([*(s for s, _ in spans), spans[-1][1] + 1]) * K.FRAME_SECONDS
    for w, own in enumerate(phones):
        final = K.final_start(own)
        for place, phone in enumerate(own):
            o, at = said.get(k), a["sound_target"][k] if spans is not None else None
            row = dict.fromkeys(("lpp", "lpr", "margin_max", "margin_mean", "seconds", "mean_seconds", "top_other"))
            row |= {"word": w, "place": place, "n": len(own), "phone": phone, "kind": o.kind if o else "del", "heard": o.heard if o else None, "final": place >= final, "function_word": flags[k]}
            if spans is not None:
                row["mean_seconds"] = float(seconds.mean())
            if at is not None:
                row |= {"lpp": float(a["lpp"][at]), "lpr": float(a["lpr"][at]), "seconds": float(seconds[at])}
                row |= _frames_of(a["limited"], spans[at], a["targets"][at], K.competitors(phone, place >= final), ids, blank, vocabulary)
            out.append(row)
            k += 1
    return out
