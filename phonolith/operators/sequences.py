"""The sequence kernels as Arrow-batched functions of columns, and the whole analysis of utterances."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from phonolith.functions.lazy import arrow_function, pandas_function
from phonolith.operators import alignment as A
from phonolith.operators import kernels as K
from phonolith.operators import trellis as T
from phonolith.operators.sounds import SOUNDS, sound_measures

OPS = "array<struct<kind:string,expected:string,heard:string,exp_pos:int,heard_pos:int>>"
ISSUES = "array<struct<word_index:int,kind:string,expected:string,heard:string,tip:string,message:string,hidden:boolean>>"
#: Log probabilities that are analysed at once.
CELLS = 1 << 20
RIVALS = "array<struct<pos:int,expected:string,tip:string,sound:string,margin:double>>"
MARGINS = "array<struct<place:int,tip:string,margin:double,greedy_expected:boolean>>"
WORDS = f"array<struct<text:string,expected:array<string>,ops:{OPS},issues:{ISSUES},dismissed:{ISSUES},gop:double,score:double,w_margin:double,w_rival:string,w_pos:int,rivals:{RIVALS},margins:{MARGINS}>>"


def _ops(ops: Sequence[K.Op]) -> list[dict]:
    return [vars(o) for o in ops]


def align(expected: Column, heard: Column, flags: Column | None = None) -> Column:
    """Edit operations of two sequences; null if one is null. flags: which expected sounds are in function words."""
    if flags is None:
        return arrow_function(OPS, A.align_arrays)(expected, heard)
    return arrow_function(OPS, A.align_arrays)(expected, heard, flags)


def edit_cost(ops: Column, flags: Column | None = None) -> Column:
    """The cost of operations, in the JVM. flags: which expected sounds are in function words."""
    from phonolith.functions import phones as P

    function = (lambda o: F.lit(False)) if flags is None else lambda o: F.coalesce(F.get(flags, o["exp_pos"]), F.lit(False))
    one = lambda o: (
        F.when(o["expected"].isNull() | o["heard"].isNull(), F.lit(K.INDEL))
        .when(o["expected"] == o["heard"], F.lit(0.0))
        .when(P.is_acceptable(o["expected"], o["heard"], function(o)), F.lit(K.VARIANT))
        .when(P.is_vowel(o["expected"]) == P.is_vowel(o["heard"]), F.lit(K.SAME_CLASS))
        .otherwise(F.lit(K.CROSS_CLASS))
    )
    return F.aggregate(ops, F.lit(0.0), lambda s, o: s + one(o))


@pandas_function("array<array<string>>")
def align_words(expected: pd.Series, heard: pd.Series, flags: pd.Series) -> pd.Series:
    """The heard word of each expected word; null where one was skipped."""
    plain = lambda x: [[list(w) for w in row] for row in x]
    return pd.Series(A.align_words_many(plain(expected), plain(heard), [list(f) for f in flags]), dtype=object)


@pandas_function("array<string>")
def narrow_to_broad(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else K.narrow_to_broad(w))


@pandas_function("struct<found:int,exact:int>")
def match_errors(expert: pd.Series, ours: pd.Series) -> pd.DataFrame:
    """Errors as arrays of (kind, expected, heard)."""
    key = lambda x: [(i["kind"], i["expected"], i["heard"]) for i in x]
    return pd.DataFrame([K.match_errors(key(e), key(o)) for e, o in zip(expert, ours, strict=True)], columns=["found", "exact"])


def _both_aligned(canonical: pd.Series, annotated: pd.Series, predicted: pd.Series, flags: pd.Series) -> tuple:
    """The columns as lists, and the alignments of the first with the second and with the third."""
    own = [list(c) for c in canonical], [list(a) for a in annotated], [list(p) for p in predicted], [list(f) if f is not None else None for f in flags]
    return *own, A.align_many(own[0], own[1], own[3]), A.align_many(own[0], own[2], own[3])


@pandas_function("struct<ta:int,fr:int,fa:int,tr:int,diagnosed:int>")
def _mdd_counts(canonical: pd.Series, annotated: pd.Series, predicted: pd.Series, flags: pd.Series) -> pd.DataFrame:
    rows = zip(*_both_aligned(canonical, annotated, predicted, flags), strict=True)
    return pd.DataFrame([K.mdd_counts(c, a, p, f, (x, y)) for c, a, p, f, x, y in rows], columns=["ta", "fr", "fa", "tr", "diagnosed"])


def mdd_counts(canonical: Column, annotated: Column, predicted: Column, flags: Column | None = None) -> Column:
    """Counts of a sentence; flags: which expected sounds are in function words."""
    return _mdd_counts(canonical, annotated, predicted, F.lit(None).cast("array<boolean>") if flags is None else flags)


@pandas_function("struct<annotated:array<string>,predicted:array<string>>")
def _states(canonical: pd.Series, annotated: pd.Series, predicted: pd.Series, flags: pd.Series) -> pd.DataFrame:
    rows = [[K.phone_states(c, a, f, x)[0], K.phone_states(c, p, f, y)[0]] for c, a, p, f, x, y in zip(*_both_aligned(canonical, annotated, predicted, flags), strict=True)]
    return pd.DataFrame(rows, columns=["annotated", "predicted"])


def phone_states(canonical: Column, annotated: Column, predicted: Column, flags: Column | None = None) -> Column:
    """For each expected sound what the annotation and the prediction made of it: null (nothing wrong), '' (missing) or
    another sound."""
    return _states(canonical, annotated, predicted, F.lit(None).cast("array<boolean>") if flags is None else flags)


@pandas_function("struct<wrong:boolean,errors:array<struct<kind:string,expected:string,heard:string,tip:string,hidden:boolean>>>")
def expert_label(text: pd.Series, expected: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """What an expert heard in one word, by the rules of the feedback; ``wrong`` is null for a skipped word."""
    rows = []
    for word, own, said in zip(text, expected, heard, strict=True):
        issues = [] if said is None else K.compare([word], [list(own)], list(said))[0].issues
        rows.append({"wrong": None if said is None else bool(issues), "errors": [{k: i[k] for k in ("kind", "expected", "heard", "tip", "hidden")} for i in issues]})
    return pd.DataFrame(rows, columns=["wrong", "errors"]).astype({"wrong": object})


@pandas_function("struct<scores:array<double>,stats:map<string,int>>")
def transfer_labels(expected: pd.Series, arpabet: pd.Series, scores: pd.Series, function: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([K.transfer_labels(list(e), list(a), list(s), bool(f)) for e, a, s, f in zip(expected, arpabet, scores, function, strict=True)], columns=["scores", "stats"])


@pandas_function("struct<ok:boolean,reason:string,tokens:array<string>,canonical:array<string>,expected:array<string>,perceived:array<string>,accented:int,errors:array<array<string>>>")
def build_target(words: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """words: array of (text, phones: array of parsed labels); raw: expected tokens by word. errors: kind, expected, heard
    and tip of each annotated error."""
    rows = [K.build_target([{"text": w["text"], "phones": list(w["phones"])} for w in ws], [list(t) for t in r]) for ws, r in zip(words, raw, strict=True)]
    rows = [r | {"errors": [[i[k] for k in ("kind", "expected", "heard", "tip")] for i in r["issues"]]} for r in rows]
    return pd.DataFrame(rows, columns=["ok", "reason", "tokens", "canonical", "expected", "perceived", "accented", "errors"])


def matrix(flat, n_vocab: int) -> np.ndarray:
    return np.asarray(flat, np.float64).reshape(-1, n_vocab)


def _matrices(lists: pa.Array, n_vocab: int) -> list[np.ndarray]:
    """The matrix of each row; rows in a row with the same values share one."""
    out, last, own = [], None, None
    for x in lists:
        flat = np.empty(0) if x.values is None else x.values.to_numpy(zero_copy_only=False)
        if last is None or not np.array_equal(flat, last):
            last, own = flat, matrix(flat, n_vocab)
        out.append(own)
    return out


def _by_vocabulary(values: pa.Array, n_vocab: pa.Array, run: Callable[[T.Frames, pa.Array], pa.Array]) -> pa.Array:
    """The results of ``run(frames, rows)`` for the rows of each size of the vocabulary, in the rows' order."""
    sizes = n_vocab.to_numpy(zero_copy_only=False)
    parts, order = [], []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        own = values.take(pa.array(at))
        lengths = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
        frames = T.Frames(own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(n)), np.append(0, np.cumsum(lengths // int(n))))
        parts.append(run(frames, pa.array(at)))
        order.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable"))) if parts else pa.array([])


def _list_of(sizes: np.ndarray, fields: dict[str, pa.Array], null: np.ndarray | None = None) -> pa.Array:
    """Lists of structs from the structs' fields, all rows in a row."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)), mask=None if null is None else pa.array(null))


def _ints(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def greedy_decode(log_probs: Column, n_vocab: Column, blank: int = 0, ignore: Sequence[int] = ()) -> Column:
    """(token, first frame) of the runs of the best token; log_probs are row-major."""

    def run(values: pa.Array, n: pa.Array) -> pa.Array:
        def part(frames: T.Frames, rows: pa.Array) -> pa.Array:
            utterance, token, at = T.greedy_decode(frames, blank, ignore)
            return _list_of(np.bincount(utterance, minlength=len(rows)), {"token": _ints(token), "frame": _ints(at)})

        return _by_vocabulary(values, n, part)

    return arrow_function("array<struct<token:int,frame:int>>", run)(log_probs, n_vocab)


def _spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list of (start, end), all rows in a row, and the rows' sizes."""
    flat = lists.flatten()
    both = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end")], 1).reshape(-1, 2)
    return both.astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def forced_align(log_probs: Column, n_vocab: Column, targets: Column, blank: int = 0) -> Column:
    """(start, end, lpp, lpr) of each target; null without a path."""

    def run(values: pa.Array, n: pa.Array, tokens: pa.Array) -> pa.Array:
        def part(frames: T.Frames, rows: pa.Array) -> pa.Array:
            own = tokens.take(rows).to_pylist()
            spans = T.forced_align(frames, own, blank)
            null = np.array([s is None for s in spans], bool)
            sizes = np.array([0 if s is None else len(s) for s in spans])
            flat = np.concatenate([s for s in spans if s is not None] or [np.empty((0, 2), np.int64)])
            lpp, lpr = T.gop_scores(frames, np.repeat(np.arange(len(own)), sizes), np.array([x for t, z in zip(own, null, strict=True) if not z for x in t], np.int64), flat, blank)
            return _list_of(sizes, {"start": _ints(flat[:, 0]), "end": _ints(flat[:, 1]), "lpp": pa.array(lpp), "lpr": pa.array(lpr)}, null)

        return _by_vocabulary(values, n, part)

    return arrow_function("array<struct<start:int,end:int,lpp:double,lpr:double>>", run)(log_probs, n_vocab, targets)


def gop_scores(log_probs: Column, n_vocab: Column, targets: Column, spans: Column, blank: int = 0) -> Column:
    """(lpp, lpr) of each target in its frames; spans: (start, end) of each."""

    def run(values: pa.Array, n: pa.Array, tokens: pa.Array, places: pa.Array) -> pa.Array:
        def part(frames: T.Frames, rows: pa.Array) -> pa.Array:
            flat, sizes = _spans(places.take(rows))
            lpp, lpr = T.gop_scores(frames, np.repeat(np.arange(len(rows)), sizes), tokens.take(rows).flatten().to_numpy(zero_copy_only=False), flat, blank)
            return _list_of(sizes, {"lpp": pa.array(lpp), "lpr": pa.array(lpr)})

        return _by_vocabulary(values, n, part)

    return arrow_function("array<struct<lpp:double,lpr:double>>", run)(log_probs, n_vocab, targets, spans)


def rival_margin(log_probs: Column, n_vocab: Column, span: Column, target: Column, rivals: Column) -> Column:
    """(margin, rival) of the rival token that leads the target most in its frames (start, end)."""

    def run(values: pa.Array, n: pa.Array, places: pa.Array, tokens: pa.Array, others: pa.Array) -> pa.Array:
        def part(frames: T.Frames, rows: pa.Array) -> pa.Array:
            own, lists = places.take(rows), others.take(rows).to_pylist()
            flat = np.stack([own.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end")], 1).reshape(-1, 2).astype(np.int64)
            margin, at = T.rival_margins(frames, np.arange(len(rows)), flat, tokens.take(rows).to_numpy(zero_copy_only=False), lists)
            return pa.StructArray.from_arrays([pa.array(margin), _ints([r[k] for r, k in zip(lists, at.tolist(), strict=True)])], ["margin", "rival"])

        return _by_vocabulary(values, n, part)

    return arrow_function("struct<margin:double,rival:int>", run)(log_probs, n_vocab, span, target, rivals)


def analyze(utterances: DataFrame, vocabulary: Sequence[str], blank: int = 0, special: Sequence[int] = (0, 1, 2, 3), sounds: bool = False, wanted: Sequence[str] | None = None, **settings) -> DataFrame:
    """Utterances with what was heard of them: ``heard, words, features, tips, phone_accuracy, aligned``.

    utterances: ``words`` (array of strings), ``raw`` (their expected tokens), ``log_probs`` (row-major), ``seconds``.
    With ``sounds`` there are also the measures of each expected sound (see ``detector``). wanted: the results to return, where not
    all are; the others never leave Python.
    settings: gop, pattern, w_margin, hidden, margins, as ``kernels.analyze_many()`` takes them. One pass without a shuffle; the
    matrices don't come back, and a task holds the results of ``CELLS`` log probabilities at a time. Raises ValueError for an
    utterance without words.
    """
    kept = [f for f in utterances.schema if f.name not in ("log_probs", "raw", "words")]
    names = ", ".join(f"{f}:double" for f in K.FEATURES)
    types = {"heard": "array<string>", "words": WORDS, "features": f"struct<{names}>", "tips": "array<string>", "phone_accuracy": "double", "aligned": "boolean", **({"sounds": SOUNDS} if sounds else {})}
    found = {n: t for n, t in types.items() if wanted is None or n in wanted}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in found.items())])
    arrow = {n: to_arrow_type(StructType.fromDDL(f"x {t}")[0].dataType) for n, t in found.items()}

    def measured(spoken: list[str], raw: list[list[str]], a: dict) -> dict:
        values = {"heard": a["heard"], "features": a["features"], "tips": a["tips"], "phone_accuracy": a["phone_accuracy"], "aligned": a["spans"] is not None}
        if "words" in found:
            values["words"] = [{**vars(w), "ops": _ops(w.ops), "score": w.score} for w in a["words"]]
        if "sounds" in found:
            values["sounds"] = sound_measures(spoken, raw, a, vocabulary, blank)
        return values

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many utterances at once as have CELLS log probabilities
            sizes = pc.fill_null(pc.list_value_length(batch.column("log_probs")), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // CELLS)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                own = batch.slice(start, end - start)
                given = [*zip(own.column("words").to_pylist(), own.column("raw").to_pylist(), _matrices(own.column("log_probs"), len(vocabulary)), own.column("seconds").to_pylist(), strict=True)]
                out = [measured(u[0], u[1], a) for u, a in zip(given, K.analyze_many(given, vocabulary, blank, special, **settings), strict=True)]
                columns = [*(own.column(f.name) for f in kept), *(pa.array([r[n] for r in out], t) for n, t in arrow.items())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *arrow])

    return utterances.mapInArrow(rows, schema)


def word_eval(analyzed: DataFrame, expert: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each word of both tables (expert: keys, word_idx, expert_wrong, expert_errors), the fact table of the
    threshold search."""
    words = analyzed.select(*keys, F.posexplode("words").alias("word_idx", "w"))
    ours = words.select(*keys, "word_idx", "w.text", "w.gop", F.col("w.issues").alias("our_errors"), "w.w_margin", "w.w_rival", "w.rivals", "w.score", (F.size("w.issues") > 0).alias("flagged"))
    return ours.join(expert, [*keys, "word_idx"])
