"""Assessment of recordings from end to end: sentence to expected sounds, recognition to feedback, and the score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.functions import phones as P
from phonolith.operators import detector as D
from phonolith.operators import models, sequences
from phonolith.sources.readers import read_json
from phonolith.sources.store import once


def phonemized(sentences: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", strict: bool = True) -> DataFrame:
    """Sentences with ``words`` and ``raw``, the tokens of each word. lexicon: ``word`` (lower case, unique), ``phones``.

    Raises for a sentence without words and for a word that the lexicon lacks. If not ``strict``, all sentences are
    returned, with ``unknown``: the words that the lexicon lacks (their tokens are empty), in order.
    """
    words = sentences.withColumn("words", P.tokenize(F.coalesce(F.col(text), F.lit(""))))
    if strict:
        words = words.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(F.raise_error(F.lit("the sentence has no words"))))
    each = words.select(*keys, F.posexplode("words").alias("_i", "_w")).withColumn("word", F.lower("_w"))
    looked = each.join(lexicon.select("word", "phones"), "word", "left")
    missing = F.raise_error(F.concat(F.lit("not in the lexicon: "), F.col("word"))) if strict else F.array()
    looked = looked.withColumn("_t", F.coalesce("phones", missing.cast("array<string>")))
    found = looked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_t", F.when(F.col("phones").isNull(), F.col("word")).alias("_u")))).alias("_x"))
    raw = found.select(*keys, F.transform("_x", lambda x: x["_t"]).alias("raw"), *([] if strict else [F.filter(F.transform("_x", lambda x: x["_u"]), lambda w: w.isNotNull()).alias("unknown")]))
    if strict:
        return words.join(raw, [*keys])
    none = {"raw": F.coalesce("raw", F.array().cast("array<array<string>>")), "unknown": F.coalesce("unknown", F.array().cast("array<string>"))}
    return words.join(raw, [*keys], "left").withColumns(none)


@dataclass
class LearnedDetector:
    """A trained model of sounds (``models.Detector``) with the statistics of right sounds and its thresholds."""

    model: models.Detector
    stats: DataFrame
    recognizer: str | None = None
    thresholds: dict[str, float] = field(default_factory=lambda: {"red": 1.01, "yellow": 1.01})

    def probabilities(self, analyzed: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = D.standardized(D.sound_rows(analyzed, keys), self.stats)
        return self.model.probabilities(rows).select(*keys, "at", "p")


@dataclass
class System:
    """How recordings are judged: ``rules`` (settings as ``kernels.analyze()`` takes them) or ``detector`` (settings:
    detector, and thresholds instead of its own)."""

    name: str
    decision: str = "rules"
    settings: dict = field(default_factory=dict)
    recognizer: str | None = None

    def assess(self, utterances: DataFrame, vocabulary: Sequence[str], keys: Sequence[str], **layout) -> DataFrame:
        """utterances: keys, words, raw, log_probs, seconds. layout: as ``sequences.analyze()`` takes it."""
        if self.decision == "rules":
            return sequences.analyze(utterances, vocabulary, **layout, **self.settings)
        if self.decision == "detector":
            learned = self.settings["detector"]
            if layout.get("wanted") is not None:
                layout = layout | {"wanted": [*layout["wanted"], "words", "sounds"]}
            analyzed = once(sequences.analyze(utterances, vocabulary, sounds=True, **layout))  # read for the sounds and for the words
            limits = self.settings.get("thresholds") or learned.thresholds
            return D.decided(analyzed, learned.probabilities(analyzed, keys), keys, limits["red"], limits["yellow"])
        raise ValueError(f"unknown decision: {self.decision}")


#: What the settings of a file are called here.
_SETTINGS = {"gop_threshold": "gop", "pattern_threshold": "pattern", "w_margin_threshold": "w_margin", "hidden_thresholds": "hidden"}


def load_system(spark: SparkSession, path: str, detectors: Mapping[str, LearnedDetector] | None = None) -> System:
    """The system that a file describes (name, recognizer, decision, settings). A threshold that is null is off, one that is
    missing has its default. detectors: trained ones, by the name a file has for them.

    Raises ValueError for a decision or setting that isn't known, KeyError for a detector that isn't there.
    """
    given = read_json(spark, path)
    decision, settings = given.get("decision", "rules"), dict(given.get("settings") or {})
    if decision == "rules":
        if unknown := settings.keys() - _SETTINGS.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        settings = {_SETTINGS[k]: v for k, v in settings.items()}
    elif decision == "detector":
        settings["detector"] = (detectors or {})[settings["detector"]]
    else:
        raise ValueError(f"unknown decision: {decision}")
    return System(given["name"], decision, settings, given.get("recognizer"))


@dataclass
class Coach:
    """Everything loaded once. A detector trained on another recogniser's output isn't used."""

    vocabulary: Sequence[str]
    lexicon: DataFrame
    recognizer: str | None = None
    scorer: object | None = None
    detector: LearnedDetector | None = None

    def assess(self, recordings: DataFrame, keys: Sequence[str]) -> DataFrame:
        """recordings: keys, text, log_probs, seconds. The feedback of each, with ``score`` (0 to 10) if there is a scorer."""
        fits = self.detector is not None and self.detector.recognizer == self.recognizer
        system = System("learned", "detector", {"detector": self.detector}) if fits else System("rules")
        found = system.assess(phonemized(recordings, self.lexicon, keys), self.vocabulary, keys)
        if self.scorer is None:
            return found
        scored = models.score(self.scorer, found.select(*keys, "features.*")).select(*keys, "score")
        return found.join(scored, [*keys])
