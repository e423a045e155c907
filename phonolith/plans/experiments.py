"""Runs of one system (recogniser output, decision and settings) over the development sets, and the comparison of two runs.

A run gives tables to report and ``units``: for each metric's units and speaker the counts that intervals and comparisons
resample (tp, fp, fn, tn, or found and all).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.operators import evaluation, reports, selection
from phonolith.operators import metrics as M
from phonolith.plans import planning
from phonolith.plans.coach import System
from phonolith.sources.store import once

# fixed values: what the system that replaces another has to reach on the archive's development speakers
TARGETS = [
    ("turkish_precision", ">=", 0.70), ("turkish_recall", ">=", 0.50), ("english_false_alarm", "<=", 0.025), ("final_voicing_catch", ">=", 0.60),
    ("th_voiced_catch", ">=", 0.40), ("th_voiceless_catch", ">=", 0.75),
]
#: Fixed value: the second limit below which a scored word counts as wrong.
CLEARLY_WRONG_BELOW = 7


def _units(counts: DataFrame, name: Column, columns: Sequence[str], speaker: Column | None = None) -> DataFrame:
    values = [F.col(c).cast("bigint") for c in columns] + [F.lit(0).cast("bigint")] * (4 - len(columns))
    return counts.select(name.alias("units"), (F.col("speaker") if speaker is None else speaker).alias("speaker"), *[v.alias(f"x{k}") for k, v in enumerate(values)])


def archive_units(words: DataFrame) -> DataFrame:
    """Units of the archive's metrics: detection in both groups, and the catch of all errors and of the reported patterns."""
    found = M.confusion(words, F.col("expert_wrong"), F.col("flagged"), "grp", "speaker")
    caught = reports.catch_units(words)
    name = F.when(F.col("name") == "errors", "saa_dev_turkish_errors").otherwise(F.concat(F.lit("saa_dev_"), "name"))
    return _units(found, F.concat(F.lit("saa_dev_"), "grp"), ("tp", "fp", "fn", "tn")).unionByName(_units(caught, name, ("found", "errors")))


def run_archive(system: System, recordings: DataFrame, transcribed: DataFrame, vocabulary: Sequence[str], words: Sequence[str], raw: Sequence[Sequence[str]], n_resamples: int = 2000) -> tuple[dict[str, DataFrame], DataFrame]:
    """The archive of one paragraph read by many speakers against experts' transcriptions.

    recordings: ``speaker, words, raw, log_probs, seconds``; transcribed: ``speaker, text``. Tables: ``words`` (the facts), ``detection``
    (both labels, with intervals), ``errors``, ``patterns``, ``pattern_stats``, ``types``, ``bias``.
    """
    analyzed = once(system.assess(recordings, vocabulary, ["speaker"]))
    facts = once(evaluation.archive_words(transcribed, analyzed, words, raw))
    labelled = facts.where("grp = 'turkish' and expert_wrong is not null")
    said = facts.groupBy("speaker", "grp").agg(F.array_sort(F.collect_list(F.struct("word_idx", "expert_phones", "expected_phones"))).alias("x"))
    side = lambda c: F.flatten(F.transform("x", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))
    sounds = said.join(analyzed.select("speaker", "heard"), "speaker").select("grp", "heard", side("expert_phones").alias("expert"), side("expected_phones").alias("expected"))
    tables = {
        "words": facts, "detection": reports.detection_with_intervals(facts, {"main": "expert_wrong", "raw": "expert_wrong_raw"}, n_resamples), "errors": evaluation.error_level_catch(labelled),
        "pattern_stats": reports.pattern_stats(facts), "types": reports.report_types(facts), "bias": reports.canonical_bias(sounds, "heard", "expert", "expected", "grp"),
    }
    if "dismissed" in facts.columns:
        tables["patterns"] = reports.pattern_table(labelled)
    return tables, archive_units(facts)


def run_scored(system: System, recordings: DataFrame, human: DataFrame, vocabulary: Sequence[str], keys: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sentences whose words experts have scored (0 to 10). recordings: keys, ``words, raw, log_probs, seconds``; human: keys,
    ``speaker`` and ``words`` (with accuracy). Tables: ``words`` and detection by two limits."""
    rows = once(evaluation.scored_words(system.assess(recordings, vocabulary, keys, wanted=["words"]), human, keys))
    tables = {"words": rows, "expert_below_10": evaluation.word_detection(rows), "expert_below_7": evaluation.word_detection(rows, CLEARLY_WRONG_BELOW)}
    return tables, _units(evaluation.confusion_by_speaker(rows), F.lit("speechocean_val"), ("tp", "fp", "fn", "tn"))


def run_synthetic(system: System, recordings: DataFrame, vocabulary: Sequence[str], engine: str = "kokoro") -> tuple[dict[str, DataFrame], DataFrame]:
    """Pairs of synthetic recordings, right and with a pattern's error. recordings: ``engine, pattern, tip, word, voice, speed, version``
    and ``words, raw, log_probs, seconds``. Tables: ``recordings`` and, for each engine, ``summary``; units of one engine."""
    keys = ["engine", "pattern", "tip", "word", "voice", "speed", "version"]
    judged = system.assess(recordings, vocabulary, keys)
    issues = F.flatten(F.transform("words", lambda w: w["issues"]))
    dismissed = F.flatten(F.transform("words", lambda w: w["dismissed"])) if "dismissed" in judged.select(F.explode("words").alias("w")).select("w.*").columns else F.array()
    flagged = F.size(issues) > 0
    rows = once(judged.select(*keys, flagged.alias("flagged"), F.exists(issues, lambda i: i["tip"].eqNullSafe(F.col("tip"))).alias("right_tip"), (~flagged & (F.size(dismissed) > 0)).alias("hidden_by_gop")))
    names = [r.engine for r in rows.select("engine").distinct().collect()]  # a few engines
    summaries = [planning.pair_summary(rows.where(F.col("engine") == n)).withColumn("engine", F.lit(n)) for n in names]
    tables = {"recordings": rows} | ({"summary": reduce(DataFrame.unionByName, summaries)} if summaries else {})
    pair = F.concat_ws("|", "pattern", "word", "voice", "speed")
    by_version = rows.where(F.col("engine") == engine).groupBy(pair.alias("speaker")).pivot("version", ["error", "correct"]).agg(F.max(F.col("flagged").cast("int")))
    both = by_version.where("error is not null and correct is not null").withColumn("all", F.lit(1))
    return tables, _units(both, F.lit(f"synthetic_{engine}_catch"), ("error", "all")).unionByName(_units(both, F.lit(f"synthetic_{engine}_false_alarm"), ("correct", "all")))


def targets(units: DataFrame) -> DataFrame:
    """``name, op, goal, value, met`` of the archive's targets, from its units."""
    sums = {r.units: r for r in units.groupBy("units").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(4)]).collect()}  # a row for each metric
    part = lambda name, a, b: (lambda r: sum(r[x] for x in a) / n if (n := sum(r[x] for x in b)) else 0.0)(sums[name]) if name in sums else None
    values = {
        "turkish_precision": part("saa_dev_turkish", ["x0"], ["x0", "x1"]), "turkish_recall": part("saa_dev_turkish", ["x0"], ["x0", "x2"]), "english_false_alarm": part("saa_dev_english", ["x1"], ["x1", "x3"]),
        **{f"{t}_catch": part(f"saa_dev_{t}", ["x0"], ["x1"]) for t in ("final_voicing", "th_voiced", "th_voiceless")},
    }
    spark = units.sparkSession
    return selection.meets_targets(spark.createDataFrame(list(values.items()), "name string, value double"), spark.createDataFrame(TARGETS, "name string, op string, goal double"))


def compare(first: Sequence[DataFrame], second: Sequence[DataFrame], n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """The metrics whose units both systems' runs have (at most the 19), with intervals of the differences."""
    whole = lambda parts: reduce(DataFrame.unionByName, parts)
    return evaluation.compare_experiments(whole(first), whole(second), n_resamples=n_resamples, seed=seed)
