"""Quality rules as a ledger: every rule is evaluated once, policies are applied to its bits afterwards.

``ledger()`` measures each document and stores a bit for every rule it fails. A policy names a version and the rules it
enforces; its verdict is one bitwise AND. Ablations (what a policy loses or gains without a rule) are counted from the
bits alone, in one aggregation over the distinct failure masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_echoes")
#: Bit number, name and failing condition of each rule; bits keep their meaning for good (6 is retired), new rules get new
#: bits. The rules are those of MassiveText (Rae et al., 2021, table A1) with its limit for symbols. Two limits are wider:
#: mean word length (there 3 to 10), because numbers and other languages count too, and repeated lines (there 0.3), which
#: would reject short texts with one heading twice. Echoes (a word that equals the one before) are repetition one word long.
RULES = (
    (0, "few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    (5, "upper_case", "2 * n_upper > n_letters and n_letters > 0"),
    (7, "echoes", "2 * n_echoes > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rules that a version of the policy enforces."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << bit for bit, name, _ in RULES}
        return sum(bits[r] for r in dict.fromkeys(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
V1 = Policy("v1", tuple(name for _, name, _ in RULES))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def repeated(words: W.Words, hashes: np.ndarray, k: int = 8) -> np.ndarray:
    """Words of runs of k words that their own text has twice or more. Hashes only name the runs that are compared."""
    grams = W.gram_hashes(hashes, k)
    at = np.flatnonzero(W.gram_inside(words.doc, k))
    if not len(at):
        return np.zeros(len(words.starts), bool)
    key = W.mix(grams[at] + words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = at[twice]
    if not len(at):
        return np.zeros(len(words.starts), bool)
    used = W.covered(at, np.full(len(at), k), len(words.starts))
    number = np.zeros(len(used), np.int64)
    number[used] = W.numbered(words, np.flatnonzero(used), hashes)
    runs = np.column_stack([words.doc[at], number[at[:, None] + np.arange(k)]])
    _, which, times = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
    at = at[times[which.ravel()] > 1]
    return W.covered(at, np.full(len(at), k), len(words.starts))


def measures_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text, by name; null counts as empty."""
    words = W.split(texts)
    data, offsets, first = words.data, words.offsets, words.first

    def by_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[first[1:]] - total[first[:-1]]

    hashes = W.word_hashes(words)
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    lines, repeats = [], []
    for text in texts.to_pylist():
        own = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        lines.append(len(own))
        repeats.append(len(own) - len(set(own)))
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": by_word(points[words.ends] - points[words.starts]),
        "n_symbols": by_text(_SYMBOL[data]),
        "n_lines": np.array(lines, np.int64),
        "n_dup_lines": np.array(repeats, np.int64),
        "n_repeat_words": by_word(repeated(words, hashes)),
        "n_letters": by_text(_LETTER[data]),
        "n_upper": by_text(_UPPER[data]),
        "n_echoes": by_word(echo),
    }


def ledger(documents: DataFrame) -> DataFrame:
    """``documents`` with the measurements and ``failures`` (bits of the rules that fail) as a struct ``quality``.

    Null and empty texts measure zero everywhere (and fail ``few_words``). Every row is measured on its own, so
    repeated rows agree; other columns pass through as they are. Lines are cut at \\n and count if they have a word.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = measures_of(part.column("text"))
                quality = pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], MEASURES)
                yield pa.RecordBatch.from_arrays([*(c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "quality"), quality], [*(n for n in part.schema.names if n != "quality"), "quality"])

    kept = documents.drop("quality")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "quality struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"])
    measured = kept.mapInArrow(rows, schema)
    bits = sum((F.when(F.expr(test.replace("n_", "quality.n_").replace("word_chars", "quality.word_chars")), 1 << bit).otherwise(0) for bit, _, test in RULES), F.lit(0)).cast("bigint")
    return measured.withColumn("quality", F.col("quality").withField("failures", bits))


def passes(policy: Policy):
    """Column: whether the ledger's row passes a policy."""
    return F.col("quality.failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(ledgers: DataFrame, policy: Policy) -> DataFrame:
    """``version, rule, fails, fails_alone``: documents that fail a rule, and those that only this rule rejects.

    Documents are first counted by failure mask, of which there are at most two to the number of rules.
    """
    masks = ledgers.groupBy(F.col("quality.failures").bitwiseAND(F.lit(policy.mask)).alias("mask")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("bigint").alias("bit")) for bit, name, _ in RULES if name in policy.rules]))
    each = masks.select("mask", "count", rules.alias("r"))
    fails = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("count")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("fails_alone")
    )
