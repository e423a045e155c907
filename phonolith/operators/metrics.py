"""Evaluation metrics as aggregations: each is one pass with partial aggregation and returns typed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolith.sources.store import once


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates of tp, fp, fn, tn: false alarm, recall, precision and F1."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {"words": tp + fp + fn + tn, "expert_wrong": tp + fn, "false_alarm": ratio(fp, fp + tn), "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def confusion(rows: DataFrame, wrong: Column, flagged: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn by group; rows with an unknown label don't count."""
    cells = {"tp": wrong & flagged, "fp": ~wrong & flagged, "fn": wrong & ~flagged, "tn": ~wrong & ~flagged}
    return rows.where(wrong.isNotNull()).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])


def detection(rows: DataFrame, wrong: Column, flagged: Column, *by: str) -> DataFrame:
    return with_rates(confusion(rows, wrong, flagged, *by))


def pearson(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation; 0 for fewer than two rows or a constant column."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = both.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("s"), ((F.min(a) == F.max(a)) | (F.min(b) == F.max(b))).alias("flat"))
    return sums.select(*by, "n", F.when((F.col("n") < 2) | F.col("flat"), 0.0).otherwise(ratio(F.col("c"), F.col("s"))).alias("correlation"))


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where null keys match each other; the right side's keys go."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def sums_below(steps: DataFrame, value: str, sums: list[str], *by: str, n_bins: int = 200) -> DataFrame:
    """``steps`` (one row for each value of a group) with ``<sum>_below``: the sums over the group's smaller values.

    Each group's values are cut at approximate quantiles; order is made within a bin only, and bins are added up on a
    table of at most ``n_bins`` rows for each group. Exact wherever the cuts fall, and no task orders a whole group.
    """
    at = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    cuts = steps.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, at, F.lit(2000))).alias("_cuts"))
    binned = _matched(steps, cuts, list(by)) if by else steps.crossJoin(F.broadcast(cuts))  # one row
    binned = binned.withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = binned.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bin", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    own = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = _matched(binned, offsets, [*by, "_bin"])
    return joined.withColumns({f"{c}_below": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).drop("_bin", *[f"_o_{c}" for c in sums])


def with_average_rank(rows: DataFrame, column: str, name: str, *by: str) -> DataFrame:
    """Rows with the rank of a column in its group, ties at their mean."""
    steps = rows.groupBy(*by, column).agg(F.count("*").alias("_n"))
    ranks = sums_below(steps, column, ["_n"], *by).select(*by, column, (F.col("_n_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return _matched(rows, ranks, [*by, column])


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = with_average_rank(with_average_rank(both, x, "_x", *by), y, "_y", *by)
    return pearson(ranked, "_x", "_y", *by)


def top_k(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The k most frequent keys; ties by first appearance."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def phone_error_rate(rows: DataFrame, reference: Column, heard: Column, *by: str) -> DataFrame:
    """Edits and length of strings with one character a sound, and their ratio."""
    sums = rows.groupBy(*by).agg(F.sum(F.levenshtein(reference, heard)).cast("bigint").alias("edits"), F.sum(F.length(reference)).cast("bigint").alias("length"))
    return sums.withColumn("per", ratio(F.col("edits"), F.col("length")))


def found_errors(expert: DataFrame, ours: DataFrame, word: list[str], sound: str) -> DataFrame:
    """By word, expert errors and how many of them a reported error at the same sound answers, each used once."""
    a = expert.groupBy(*word, sound).agg(F.count("*").alias("a"))
    b = ours.groupBy(*word, sound).agg(F.count("*").alias("b"))
    both = a.join(b, [*word, sound], "left").groupBy(*word)
    return both.agg(F.sum("a").alias("errors"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("found"))


def catch_report(words: DataFrame) -> DataFrame:
    """Caught share of all errors, and words of several errors of which all, some or none were found."""
    several = F.col("errors") >= 2
    out = words.agg(
        F.sum("errors").alias("expert_errors"), F.sum("found").alias("caught"), F.count_if(several).alias("multi_words"), F.count_if(several & (F.col("found") == F.col("errors"))).alias("multi_all"),
        F.count_if(several & (F.col("found") > 0) & (F.col("found") < F.col("errors"))).alias("multi_some"), F.count_if(several & (F.col("found") == 0)).alias("multi_none"),
    )
    return out.withColumn("catch", ratio(F.col("caught"), F.col("expert_errors")))


def mdd(rows: DataFrame, canonical: Column, annotated: Column, predicted: Column, *by: str) -> DataFrame:
    """Mispronunciation detection on aligned sounds: counts by annotation and prediction, and their rates."""
    bad, said = ~annotated.eqNullSafe(canonical), ~predicted.eqNullSafe(canonical)
    cells = {"ta": ~bad & ~said, "fr": ~bad & said, "fa": bad & ~said, "tr": bad & said, "diagnosed": bad & said & annotated.eqNullSafe(predicted)}
    return with_mdd_rates(rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()]))


def with_mdd_rates(counts: DataFrame) -> DataFrame:
    ta, fr, fa, tr, ok = (F.col(c) for c in ("ta", "fr", "fa", "tr", "diagnosed"))
    return counts.withColumns({"precision": ratio(tr, tr + fr), "recall": ratio(tr, tr + fa), "f1": ratio(2 * tr, 2 * tr + fr + fa), "diagnosis_accuracy": ratio(ok, tr), "false_rejection": ratio(fr, ta + fr)})


def utterance_features(rows: DataFrame, key: str, kind: Column, lpp: Column, lpr: Column, bad: float = -2.0) -> DataFrame:
    """Rates of matches, substitutions, deletions and insertions, and means, minima, 10 % point and bad share of scores."""
    count = lambda k: F.count_if(kind == k)
    expected = F.greatest(count("match") + count("sub") + count("del"), F.lit(1))
    return rows.groupBy(key).agg(
        ratio(count("match"), F.count("*")).alias("phone_accuracy"), ratio(count("sub"), expected).alias("sub_rate"), ratio(count("del"), expected).alias("del_rate"), ratio(count("ins"), expected).alias("ins_rate"),
        F.avg(lpp).alias("lpp_mean"), F.min(lpp).alias("lpp_min"), F.avg(lpr).alias("lpr_mean"), F.min(lpr).alias("lpr_min"), F.percentile(lpr, F.lit(0.1)).alias("lpr_p10"), F.avg((lpr < bad).cast("int")).alias("bad_frac"),
    )


def gop_stats(rows: DataFrame, phone: str, value: str, least_rows: int = 20, least_std: float = 0.25) -> DataFrame:
    """Mean and floored population deviation of each sound with enough rows, and of all sounds (null), in one pass."""
    stats = rows.rollup(phone).agg(F.grouping(phone).alias("is_all"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(least_std)).alias("std"))
    return stats.where((F.col("is_all") == 1) | ((F.col("n") >= least_rows) & F.col(phone).isNotNull()))


def z_scores(rows: DataFrame, stats: DataFrame, phone: str, value: str) -> DataFrame:
    """Rows with ``z``; sounds without statistics of their own use those of all sounds."""
    own = stats.where("is_all = 0").select(phone, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    every = stats.where("is_all = 1").select(F.col("mean").alias("_am"), F.col("std").alias("_as"))  # one row
    joined = rows.join(own, phone, "left").crossJoin(F.broadcast(every))
    return joined.withColumn("z", (F.col(value) - F.coalesce("_m", "_am")) / F.coalesce("_s", "_as")).drop("_m", "_s", "_am", "_as")


def auc_and_ap(rows: DataFrame, score: str, label: Column, *by: str) -> DataFrame:
    """By group: area under the ROC curve (ties count half) and stepwise average precision; null for one class alone."""
    # read for the cuts and for the sums; the rows behind it are scored once
    steps = once(rows.where(F.col(score).isNotNull()).groupBy(*by, (-F.col(score)).alias("_down")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n")))
    curve = sums_below(steps, "_down", ["p", "n"], *by)
    p, n, tp = F.col("p"), F.col("n"), F.col("p_below") + F.col("p")
    # negatives scored above, and half of those scored alike, lose against each positive
    lost = F.sum(p * (F.col("n_below") + n / 2.0))
    sums = curve.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), lost.alias("lost"), F.sum(p * tp / (tp + F.col("n_below") + n)).alias("ap"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(*by, "pos", "neg", F.when(both, 1 - F.col("lost") / (F.col("pos") * F.col("neg"))).alias("auc"), F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("ap"))
