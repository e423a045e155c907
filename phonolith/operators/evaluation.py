"""Evaluation put together: fact tables of two corpora, error-level catch, selection with estimates on held-out speakers, the
metrics of a comparison, manifests for fine-tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.functions import inventory as I
from phonolith.functions import phones as P
from phonolith.operators import metrics as M
from phonolith.operators import reports, selection, sequences
from phonolith.operators.windows import deal_folds

#: Fixed value: a word with a lower score (of 10) than this counts as wrong.
WRONG_BELOW = 10
# fixed values: label, name of the units and statistic of each metric that two systems are compared by
COMPARED = [
    ("SAA dev, Turkish: recall", "saa_dev_turkish", "recall"), ("SAA dev, Turkish: precision", "saa_dev_turkish", "precision"), ("SAA dev, Turkish: F1", "saa_dev_turkish", "f1"),
    ("SAA dev, Turkish: false alarm", "saa_dev_turkish", "false_alarm"), ("SAA dev, Turkish: error-level catch", "saa_dev_turkish_errors", "catch"),
    ("SAA dev, Turkish: final devoicing catch", "saa_dev_final_voicing", "catch"), ("SAA dev, Turkish: z → s catch", "saa_dev_z_to_s", "catch"), ("SAA dev, Turkish: ð catch", "saa_dev_th_voiced", "catch"),
    ("SAA dev, Turkish: θ catch", "saa_dev_th_voiceless", "catch"), ("SAA dev, Turkish: w catch", "saa_dev_w", "catch"), ("SAA dev, Turkish: ɪ → i catch", "saa_dev_short_i", "catch"),
    ("SAA dev, Turkish: r catch", "saa_dev_r", "catch"), ("SAA dev, English: false alarm", "saa_dev_english", "false_alarm"), ("speechocean val: recall", "speechocean_val", "recall"),
    ("speechocean val: precision", "speechocean_val", "precision"), ("speechocean val: false alarm", "speechocean_val", "false_alarm"), ("speechocean val: F1", "speechocean_val", "f1"),
    ("synthetic Kokoro: catch", "synthetic_kokoro_catch", "catch"), ("synthetic Kokoro: false alarm", "synthetic_kokoro_false_alarm", "catch"),
]


# --- fact tables -----------------------------------------------------------------------------------------------------


def pairs_of(issues: Column) -> Column:
    return F.transform(issues, lambda i: P.pair_label(i["expected"], i["heard"]))


def tips_of(issues: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(issues, lambda i: i["tip"]), lambda t: t.isNotNull())))


def archive_words(transcribed: DataFrame, analyzed: DataFrame, words: Sequence[str], raw: Sequence[Sequence[str]]) -> DataFrame:
    """One row for each word of the paragraph and speaker: what the expert heard and what the system reports.

    transcribed: ``speaker, text`` (narrow transcription); analyzed: ``speaker, words`` as ``sequences.analyze()`` or the
    detector returns them; words, raw: the paragraph, the same for all. Speakers of one side only have no rows;
    ``expert_wrong`` is null for a skipped word.
    """
    texts = F.array(*map(F.lit, words))
    phones = F.array(*[P.merge_repeats(P.normalize(F.array(*map(F.lit, own)))) for own in raw])
    flags = F.array(*[F.lit(w.lower() in I.FUNCTION_WORDS) for w in words])
    heard = transcribed.select("speaker", F.posexplode(P.transcription_words(F.col("text"))).alias("place", "ipa"))
    heard = heard.select("speaker", "place", "ipa", sequences.narrow_to_broad(F.col("ipa")).alias("broad"))
    heard = heard.groupBy("speaker").agg(F.array_sort(F.collect_list(F.struct("place", "broad", "ipa"))).alias("said"))
    aligned = sequences.align_words(phones, F.transform("said", lambda s: s["broad"]), flags)
    expert = heard.withColumn("expert", aligned).select("speaker", F.posexplode(F.arrays_zip(texts.alias("word"), phones.alias("expected_phones"), F.col("expert").alias("expert_phones"))).alias("word_idx", "x"))
    expert = expert.select("speaker", "word_idx", "x.*").withColumn("_l", sequences.expert_label(F.col("word"), F.col("expected_phones"), F.col("expert_phones")))
    expert = expert.withColumns({"expert_wrong": F.col("_l.wrong"), "expert_errors": F.col("_l.errors"), "expert_wrong_raw": P.raw_wrong(F.col("expected_phones"), F.col("expert_phones"))}).drop("_l")
    optional = [c for c in ("level", "error_prob", "dismissed", "w_margin", "w_rival", "rivals") if c in analyzed.select(F.explode("words").alias("w")).select("w.*").columns]
    # both sides' errors have the same fields
    plain = lambda issues: F.transform(issues, lambda i: F.struct(*[i[c].alias(c) for c in ("kind", "expected", "heard", "tip", "hidden")]))
    ours = analyzed.select("speaker", F.posexplode("words").alias("word_idx", "w"))
    ours = ours.select("speaker", "word_idx", plain(F.col("w.issues")).alias("our_errors"), "w.gop", *[(plain(F.col("w.dismissed")) if c == "dismissed" else F.col(f"w.{c}")).alias(c) for c in optional])
    both = expert.join(ours, ["speaker", "word_idx"])
    return both.withColumns(
        {
            "grp": P.speaker_group(F.col("speaker")), "flagged": F.size("our_errors") > 0, "expert_tips": tips_of(F.col("expert_errors")), "expert_pairs": pairs_of(F.col("expert_errors")),
            "our_tips": tips_of(F.col("our_errors")), "our_pairs": pairs_of(F.col("our_errors")),
        }
    )


def scored_words(analyzed: DataFrame, human: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``speaker, accuracy, our_score, flagged, pairs`` of each word of utterances that have as many words on both sides.

    analyzed: keys and ``words`` (with score and issues); human: keys, ``speaker`` and ``words`` (with accuracy).
    """
    # only what is returned of a word goes through the join, and neither table is broadcast
    ours = F.transform("words", lambda w: F.struct(w["score"].alias("our_score"), (F.size(w["issues"]) > 0).alias("flagged"), pairs_of(w["issues"]).alias("pairs")))
    theirs = human.select(*keys, "speaker", F.transform("words", lambda w: w["accuracy"]).alias("accuracy"))
    both = analyzed.select(*keys, ours.alias("ours")).hint("merge").join(theirs, [*keys])
    each = both.where(F.size("ours") == F.size("accuracy")).select("speaker", F.explode(F.arrays_zip("accuracy", "ours")).alias("x"))
    return each.select("speaker", "x.accuracy", "x.ours.our_score", "x.ours.flagged", "x.ours.pairs")


def word_detection(rows: DataFrame, wrong_below: float = WRONG_BELOW) -> DataFrame:
    """One row: detection of words that experts score below the limit, and ``pcc``, the correlation of both scores."""
    found = M.detection(rows, F.col("accuracy") < wrong_below, F.col("flagged"))
    return found.crossJoin(F.broadcast(M.pearson(rows, "our_score", "accuracy").select(F.col("correlation").alias("pcc"))))  # one row each


def confusion_by_speaker(rows: DataFrame, wrong_below: float = WRONG_BELOW) -> DataFrame:
    """``speaker, tp, fp, fn, tn``: the units of intervals and comparisons."""
    return M.confusion(rows, F.col("accuracy") < wrong_below, F.col("flagged"), "speaker")


# --- errors ----------------------------------------------------------------------------------------------------------


def error_level_catch(words: DataFrame) -> DataFrame:
    """One row: expert errors, found and exactly found ones with their shares, and words of several errors.

    words: ``expert_errors, our_errors``.
    """
    matched = words.select(F.size("expert_errors").alias("n"), sequences.match_errors(F.col("expert_errors"), F.col("our_errors")).alias("m"))
    several, found = F.col("n") >= 2, F.col("m.found")
    sums = matched.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("expert_errors"), F.coalesce(F.sum(found), F.lit(0)).alias("found"), F.coalesce(F.sum("m.exact"), F.lit(0)).alias("found_exact"), F.count_if(several).alias("multi_error_words"),
        F.count_if(several & (found == F.col("n"))).alias("multi_all"), F.count_if(several & (found > 0) & (found < F.col("n"))).alias("multi_some"), F.count_if(several & (found == 0)).alias("multi_none"),
    )
    return sums.withColumns({"catch": M.ratio(F.col("found"), F.col("expert_errors")), "exact": M.ratio(F.col("found_exact"), F.col("expert_errors"))})


def catch_by_tip(words: DataFrame) -> DataFrame:
    """``tip, errors, found``: each expert error on its own, so one report can answer several errors."""
    each = words.select("our_errors", F.explode("expert_errors").alias("e")).where("e.tip is not null")
    found = F.exists("our_errors", lambda o: reports.same_place(F.col("e"), o))
    return each.groupBy("e.tip").agg(F.count("*").alias("errors"), F.count_if(found).alias("found"))


def native_report(rows: DataFrame) -> DataFrame:
    """One row for native sentences: their number, error rate, and how often right sounds are rejected. rows: expected,
    recognized, function."""
    counted = rows.withColumn("_c", sequences.mdd_counts(F.col("expected"), F.col("expected"), F.col("recognized"), F.col("function")))
    edits = F.levenshtein(*P.as_symbols(F.col("expected"), F.col("recognized")))
    fr, ta = F.sum("_c.fr"), F.sum("_c.ta")
    return counted.agg(F.count("*").alias("sentences"), M.ratio(F.sum(edits), F.sum(F.size("expected"))).alias("per"), M.ratio(fr, ta + fr).alias("false_rejection_rate"))


def compare_experiments(a: DataFrame, b: DataFrame, metrics: Sequence[tuple[str, str, str]] = tuple(COMPARED), n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Every metric whose units both experiments have, in the order of the list (``ordinal``), as ``compare_systems()``.

    a, b: ``units, speaker, x0, x1, x2, x3`` (tp, fp, fn, tn, or found and errors).
    """
    listed = a.sparkSession.createDataFrame([(*m, i) for i, m in enumerate(metrics)], "metric string, units string, statistic string, ordinal int")
    named = lambda df: df.join(F.broadcast(listed), "units").select("metric", "statistic", "speaker", "x0", "x1", "x2", "x3")  # noqa: E731  a fixed list
    return reports.compare_systems(named(a), named(b), n_resamples, seed).join(F.broadcast(listed.drop("statistic")), "metric")


def speaker_summary(rows: DataFrame, by: Sequence[str], values: Sequence[str], share: Column | None = None) -> DataFrame:
    """Rows of each group with mean, least and largest of some columns, and the share of rows for which a condition holds."""
    parts = [x(c).alias(f"{c}_{n}") for c in values for n, x in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *parts, *([F.avg(share.cast("double")).alias("share")] if share is not None else []))


def first_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an explicit order, in one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(key, "_x.*")


# --- selection on development speakers -------------------------------------------------------------------------------


def held_out_bands(rows: DataFrame, n_folds: int = 6, **limits) -> DataFrame:
    """Rows (grp, speaker, p, wrong, extra) with ``fold, flagged, red_flagged`` by the thresholds chosen on the speakers of
    the other folds; the speakers of each group are dealt in order. One job for all folds."""
    folds = deal_folds(rows.select("grp", "speaker"), "grp", "speaker", n_folds)
    dealt = rows.join(folds, ["grp", "speaker"])
    held = folds.select(F.col("fold").alias("held_out")).distinct()
    chosen = selection.choose_bands(dealt.join(F.broadcast(held), F.col("fold") != F.col("held_out")), "held_out", **limits)
    both = dealt.join(F.broadcast(chosen.withColumnRenamed("held_out", "fold")), "fold")
    return both.withColumns({"flagged": (F.col("p") >= F.col("yellow")) | F.col("extra"), "red_flagged": F.col("p") >= F.col("red")})


def select_on_dev(rows: DataFrame, n_folds: int = 6, **limits) -> dict[str, DataFrame]:
    """Thresholds chosen on all speakers, detection with them, the estimate on held-out speakers, and average precision.

    rows: grp, speaker, p, wrong, extra; words without a label are left out by the caller. ``in_sample`` and
    ``held_out`` have one row for each group, and ``turkish_red`` for red alone.
    """
    thresholds = selection.choose_bands(rows, **limits)
    own = rows.crossJoin(F.broadcast(thresholds)).withColumns({"flagged": (F.col("p") >= F.col("yellow")) | F.col("extra"), "red_flagged": F.col("p") >= F.col("red")})

    def measured(judged: DataFrame) -> DataFrame:
        red = M.detection(judged.where("grp = 'turkish'").withColumn("grp", F.lit("turkish_red")), F.col("wrong"), F.col("red_flagged"), "grp")
        return M.detection(judged, F.col("wrong"), F.col("flagged"), "grp").unionByName(red)

    return {
        "thresholds": thresholds, "in_sample": measured(own), "held_out": measured(held_out_bands(rows, n_folds, **limits)),
        "average_precision": M.auc_and_ap(rows.where("grp = 'turkish'"), "p", F.col("wrong")).select("ap"),
    }


def best_label(candidates: dict[str, dict[str, DataFrame]]) -> str:
    """Of label definitions with what ``select_on_dev()`` returned, the one with the most held-out Turkish recall, ties by
    average precision, then the first."""

    def worth(found: dict[str, DataFrame]) -> tuple[float, float]:
        return found["held_out"].where("grp = 'turkish'").first().recall, found["average_precision"].first().ap or 0.0

    values = {name: worth(found) for name, found in candidates.items()}
    return max(values, key=values.get)


def cross_validate_generalized(rows: DataFrame, folds: DataFrame, **options) -> tuple[DataFrame, list[dict]]:
    """Rows as the settings chosen without their speaker's fold have them, and what was chosen for each fold. folds:
    speaker, fold; the search is sequential by definition, so folds follow each other."""
    dealt, out, chosen = rows.join(folds, "speaker"), None, []
    for fold in sorted(r.fold for r in folds.select("fold").distinct().collect()):  # a fixed number of folds
        pick = selection.select_generalized(dealt.where(F.col("fold") != fold), **options)
        chosen.append({"fold": fold, **pick})
        part = selection.apply_settings(dealt.where(F.col("fold") == fold), pick["settings"])
        out = part if out is None else out.unionByName(part)
    return out, chosen


# --- manifests -------------------------------------------------------------------------------------------------------


def _prepared(words: Column, raw: Column) -> tuple[Column, Column]:
    """Expected sounds in a row, and which of them are in function words."""
    known = F.array(*map(F.lit, sorted(I.FUNCTION_WORDS)))
    own = F.transform(raw, lambda r: P.merge_repeats(P.normalize(r)))
    flags = F.transform(F.arrays_zip(words.alias("w"), own.alias("p")), lambda x: F.transform(x["p"], lambda _: F.array_contains(known, F.lower(x["w"]))))
    return F.flatten(own), F.flatten(flags)


def manifest(annotated: DataFrame, vocabulary: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Annotated sentences as rows for fine-tuning, and how many were kept or left out for which reason.

    annotated: ``words`` (array of text and parsed phones; null: a label that couldn't be parsed), ``raw`` (expected tokens
    by word) and any other columns, which stay. Rows get text, tokens, canonical, expected, perceived, function, errors.
    """
    known = F.array(*map(F.lit, sorted(vocabulary)))
    empty = F.array().cast(annotated.schema["words"].dataType)
    built = annotated.withColumn("_t", sequences.build_target(F.coalesce("words", empty), F.when(F.col("words").isNull(), F.array().cast("array<array<string>>")).otherwise(F.col("raw"))))
    unknown = F.size(F.array_except(F.concat("_t.tokens", "_t.canonical"), known)) > 0
    reason = F.when(F.col("words").isNull(), "bad label").when(~F.col("_t.ok"), F.col("_t.reason")).when(unknown, "token not in vocab").otherwise("kept")
    texts = F.transform("words", lambda w: w["text"])
    judged = built.withColumn("reason", reason)
    flags = _prepared(texts, F.col("raw"))[1]
    rows = judged.where("reason = 'kept'").withColumns({"text": F.array_join(texts, " "), "tokens": F.array_join("_t.tokens", " "), "function": flags, **{c: F.col(f"_t.{c}") for c in ("canonical", "expected", "perceived", "errors")}})
    return rows.drop("_t", "reason", "words", "raw"), judged.groupBy("reason").agg(F.count("*").alias("n"))


def native_manifest(prompts: DataFrame, vocabulary: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Native sentences, taken as said right, in the form of ``manifest()``. prompts: ``words`` (texts), ``raw``, others."""
    known = F.array(*map(F.lit, sorted(vocabulary)))
    tokens = F.flatten("raw")
    judged = prompts.withColumn("reason", F.when(F.size(F.array_except(tokens, known)) > 0, "token not in vocab").otherwise("kept"))
    flat, flags = _prepared(F.col("words"), F.col("raw"))
    none = F.array().cast("array<array<string>>")
    rows = judged.where("reason = 'kept'").withColumns({"text": F.array_join("words", " "), "tokens": F.array_join(tokens, " "), "canonical": tokens, "expected": flat, "perceived": flat, "function": flags, "errors": none, "l1": F.lit("English")})
    return rows.drop("reason", "words", "raw"), judged.groupBy("reason").agg(F.count("*").alias("n"))
