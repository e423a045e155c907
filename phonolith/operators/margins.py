"""Can the frames of a sound tell an error pattern from a right sound? Margins of typical replacements against experts' labels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.functions import inventory as I
from phonolith.functions.lazy import pandas_function
from phonolith.operators import kernels as K
from phonolith.operators.resampling import auc_interval

#: The margins at which the rule of the hidden w is reported.
W_MARGINS = [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -6.0, -7.0, -8.0]
_ITEMS = "array<struct<word:int,place:int,pattern:string,label:int,margin:double,greedy_expected:boolean>>"


@pandas_function(_ITEMS)
def _items(words: pd.Series, heard: pd.Series, turkish: pd.Series) -> pd.Series:
    flat = [(w["text"], list(w["expected"]), None if h is None else list(h), list(w["margins"])) for ws, hs in zip(words, heard, strict=True) for w, h in zip(ws, hs, strict=True)]
    sizes = [len(ws) for ws in words]
    found = iter(K.sound_labels(flat, [bool(t) for t, n in zip(turkish, sizes, strict=True) for _ in range(n)]))
    return pd.Series([[{"word": k, **item} for k in range(n) for item in next(found)] for n in sizes], dtype=object)


def labelled_sounds(analyzed: DataFrame, keys: Sequence[str], heard: Column, turkish: Column) -> DataFrame:
    """One row for each expected sound and pattern of it: keys, ``word, place, pattern, label, margin, greedy_expected``.

    analyzed: utterances of ``sequences.analyze(..., margins=True)``. heard: what an expert heard of each of their words, null for a
    skipped one (``sequences.align_words``). Words and labels of an utterance are in one row, so nothing is shuffled.
    """
    return analyzed.select(*keys, F.explode(_items("words", heard, turkish)).alias("_i")).select(*keys, "_i.*")


def sound_items(labelled: DataFrame) -> DataFrame:
    """The items of the patterns, without those of the rule of the hidden w."""
    return labelled.where("pattern is not null")


def w_items(labelled: DataFrame) -> DataFrame:
    """The items of the rule of the hidden w: every w with v, β or ʋ."""
    return labelled.where("pattern is null").drop("pattern", "greedy_expected")


def pattern_margins(items: DataFrame, speaker: str, native: Column, n_resamples: int = 2000) -> DataFrame:
    """By pattern: experts' errors, right sounds of Turkish and of native speakers, errors that decoding wrote as the expected sound, and
    the area under the curve of the margin with its interval over speakers (null without both kinds)."""
    wrong = F.col("label") == 1
    counts = items.groupBy("pattern").agg(
        F.count_if(wrong).alias("errors"), F.count_if(~wrong & ~native).alias("right_turkish"), F.count_if(~wrong & native).alias("right_native"), F.count_if(wrong & F.col("greedy_expected")).alias("missed"),
    )
    return counts.join(auc_interval(items, speaker, "margin", wrong, n_resamples, by=["pattern"]), "pattern", "left")


def in_pattern_order(table: DataFrame) -> DataFrame:
    """A row for each pattern that can be hidden, in their fixed order, with zero counts where there is none."""
    order = table.sparkSession.createDataFrame([(t, k) for k, t in enumerate(x for x in I.TIP_ORDER if x != "epenthesis")], "pattern string, ordinal int")
    return order.join(table, "pattern", "left").fillna(0, [c for c in table.columns if c in ("errors", "right_turkish", "right_native", "missed")])


def w_rule(items: DataFrame, speaker: str, native: Column, n_resamples: int = 2000) -> DataFrame:
    """One row: ``errors, right_turkish, right_native``, the median margin of each, and ``auc, low, high`` over speakers."""
    wrong = F.col("label") == 1
    parts = {"errors": wrong, "right_turkish": ~wrong & ~native, "right_native": ~wrong & native}
    counts = items.agg(*[F.count_if(c).alias(n) for n, c in parts.items()], *[F.percentile(F.when(c, F.col("margin")), F.lit(0.5)).alias(f"{n}_median") for n, c in parts.items()])
    return counts.crossJoin(auc_interval(items, speaker, "margin", wrong, n_resamples))  # one row each
