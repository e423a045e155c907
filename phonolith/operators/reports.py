"""Reports on stored words (see ``selection``) and sentences: catch by pattern, precision of reports, intervals, errors
of annotated sentences, recognisers, and examples of what changed between two systems.

Errors and reports stay arrays on their word, so matching them is an expression of the row; each report is one or two
aggregations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolith.functions import inventory as I
from phonolith.functions import phones as P
from phonolith.operators import metrics as M
from phonolith.operators import resampling, sequences

# --- fixed values: pairs of expected and heard sounds that reports list ------------------------------------------------

FOCUS = [("z", "s"), ("θ", "t"), ("ð", "d"), ("ɪ", "iː"), ("w", "v"), ("æ", "ɛ"), ("ɹ", "ɾ")]
TYPICAL_PAIRS = [("z", "s"), ("θ", "t"), ("θ", "s"), ("ð", "d"), ("ð", "z"), ("ɪ", "i"), ("ɪ", "iː"), ("iː", "ɪ"), ("w", "v"), ("v", "w"), ("æ", "ɛ"), ("ʊ", "uː"), ("d", "t"), ("b", "p"), ("ɡ", "k")]
PREFERRED = [("z", "s"), ("ð", "d"), ("θ", "t"), ("w", "v"), ("ɹ", "ɾ"), ("ɹ", "r"), ("ɪ", "i"), ("v", "f"), ("d", "t")]
CAUGHT_PATTERNS = ("final_voicing", "z_to_s", "th_voiced", "th_voiceless", "w", "short_i", "r")

_LABELLED = "grp = 'turkish' and expert_wrong is not null"


def same_place(a: Column, b: Column) -> Column:
    """Whether two errors are on the same sound: both added sounds, or both on the same expected one."""
    added = lambda x: x["kind"] == "ins"
    return F.when(added(a) | added(b), added(a) & added(b)).otherwise(a["expected"].eqNullSafe(b["expected"]))


def found_errors(expert: Column, ours: Column) -> Column:
    """How many expert errors of a word have a report on their sound, each report used once."""
    place = lambda x: F.when(x["kind"] == "ins", F.lit("")).otherwise(x["expected"])
    theirs, own = F.transform(expert, place), F.transform(ours, place)
    count = lambda xs, p: F.size(F.filter(xs, lambda x: x.eqNullSafe(p)))
    return F.aggregate(F.array_distinct(theirs), F.lit(0), lambda n, p: n + F.least(count(theirs, p), count(own, p)))


def names_expert_error(issue: Column, expert: Column) -> Column:
    """Whether the expert heard the reported pattern's error on that sound."""
    return F.exists(expert, lambda e: e["kind"].eqNullSafe(issue["kind"]) & e["expected"].eqNullSafe(issue["expected"]) & e["tip"].eqNullSafe(issue["tip"]))


def on_expert_sound(issue: Column, expert: Column) -> Column:
    """Whether the expert marked the sound of a report (for an added sound: heard one too)."""
    return F.exists(expert, lambda e: same_place(issue, e))


def issue_keys(issues: Column) -> Column:
    """What two lists of reports are compared by."""
    return F.transform(issues, lambda i: F.struct(*[i[c].alias(c) for c in ("kind", "expected", "heard", "tip", "hidden")]))


def reported_accuracy(words: Column) -> Column:
    """Share of the sounds of an utterance's words without a reported error; added sounds count on both sides."""
    issues = F.flatten(F.transform(words, lambda w: w["issues"]))
    added = F.size(F.filter(issues, lambda i: i["kind"] == "ins"))
    expected = F.aggregate(words, F.lit(0), lambda n, w: n + F.size(w["expected"]))
    return M.ratio(expected - (F.size(issues) - added), expected + added)


def top_pairs(rows: DataFrame, pairs: str, order: str, n: int = 15) -> DataFrame:
    """The most frequent members of an array column; ties by first appearance in ``order``."""
    each = rows.select(F.col(order).alias("_order"), F.posexplode(pairs).alias("_i", "pair"))
    return M.top_k(each.withColumn("_order", F.struct("_order", "_i")), "pair", "_order", n).select("pair", "n")


# --- errors by pattern -----------------------------------------------------------------------------------------------


def _by_tip(rows: DataFrame) -> DataFrame:
    """A row for each word and pattern in its errors or reports, with what it counts there."""
    of = lambda xs, tip, more=None: F.filter(xs, lambda x: (x["tip"] == tip) & (more(x) if more else F.lit(True)))
    tips = F.array_distinct(F.filter(F.transform(F.concat("expert_errors", "our_errors"), lambda x: x["tip"]), lambda t: t.isNotNull()))
    each = rows.withColumn("tip", F.explode(tips))
    tip, expert, ours = F.col("tip"), F.col("expert_errors"), F.col("our_errors")
    right = lambda i: names_expert_error(i, expert)
    hidden = lambda i: F.coalesce(i["hidden"], F.lit(False))
    counts = {
        "errors": of(expert, tip), "found": of(expert, tip, lambda e: F.exists(ours, lambda o: same_place(e, o))), "reports": of(ours, tip), "right": of(ours, tip, right),
        "hidden_reports": of(ours, tip, hidden), "hidden_right": of(ours, tip, lambda i: hidden(i) & right(i)),
    }
    return each.withColumns({n: F.size(x) for n, x in counts.items()})


def _tip_order(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(I.TIP_ORDER)], "tip string, ordinal int")


def pattern_table(rows: DataFrame) -> DataFrame:
    """Patterns the expert heard: words with them, shares flagged and with the right pattern, errors, the share found
    (each error on its own) and words where every report was dismissed. rows also have ``flagged`` and ``dismissed``."""
    heard = _by_tip(rows).where("errors > 0")
    gone = (F.size("our_errors") == 0) & (F.size("dismissed") > 0)
    table = heard.groupBy("tip").agg(
        F.count("*").alias("words"), F.avg(F.col("flagged").cast("int")).alias("word_caught"), F.avg((F.col("reports") > 0).cast("int")).alias("right_tip"),
        F.sum("errors").alias("errors"), M.ratio(F.sum("found"), F.sum("errors")).alias("error_caught"), F.count_if(gone).alias("hidden_by_gop"),
    )
    return F.broadcast(_tip_order(rows)).join(table, "tip")


def pattern_stats(rows: DataFrame) -> DataFrame:
    """Every pattern on labelled Turkish words: expert errors and those found, reports and those that name the error."""
    names = ("errors", "found", "reports", "right", "hidden_reports", "hidden_right")
    sums = _by_tip(rows.where(_LABELLED)).groupBy("tip").agg(*[F.sum(n).alias(n) for n in names])
    return F.broadcast(_tip_order(rows)).join(sums, "tip", "left").select("tip", "ordinal", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def report_types(rows: DataFrame) -> DataFrame:
    """Kinds of reports (a heard pattern, another difference, a hidden pattern): words with them, those the expert found
    wrong, reports, those on a marked sound and with the right pattern, and correct native words with them. One pass."""
    hidden = lambda i: F.coalesce(i["hidden"], F.lit(False))
    kinds = {"heard pattern": lambda i: i["tip"].isNotNull() & ~hidden(i), "other difference": lambda i: i["tip"].isNull(), "hidden pattern": hidden}
    expert, ours, wrong = F.col("expert_errors"), F.col("our_errors"), F.col("expert_wrong")
    turkish, native = F.col("grp") == "turkish", (F.col("grp") == "english") & ~wrong
    size = lambda f: F.sum(F.when(turkish, F.size(F.filter(ours, f))).otherwise(0))
    both = lambda f, right: lambda i: f(i) & right(i, expert)
    aggs = [F.count_if(native).alias("native_correct_words")]
    for k, (name, kind) in enumerate(kinds.items()):
        has = F.exists(ours, kind)
        values = {
            "words": F.count_if(turkish & has), "wrong_words": F.count_if(turkish & has & wrong), "reports": size(kind), "on_expert_sound": size(both(kind, on_expert_sound)),
            "right_pattern": F.lit(None).cast("bigint") if name == "other difference" else size(both(kind, names_expert_error)), "native_words": F.count_if(native & has),
        }
        aggs.append(F.struct(F.lit(name).alias("type"), *[c.alias(n) for n, c in values.items()]).alias(f"k{k}"))
    one = rows.where("expert_wrong is not null").agg(*aggs)
    each = F.array(*[f"k{k}" for k in range(len(kinds))])
    return one.select(F.explode(each).alias("x"), "native_correct_words").select("x.*", "native_correct_words")


def hidden_w_precision(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each margin threshold, reports of a hidden w on Turkish words (labelled or not) and those where the expert
    marked the w. All thresholds in one pass."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    right = F.exists("expert_errors", lambda e: (e["expected"] == "w") & (e["kind"] != "ins"))
    margin = F.when(~F.isnan("w_margin"), F.col("w_margin"))
    each = rows.where("grp = 'turkish'").select(margin.alias("m"), right.alias("right"), F.explode(grid).alias("threshold"))
    hit = F.coalesce(F.col("m") > F.col("threshold"), F.lit(False))
    return each.groupBy("threshold").agg(F.count_if(hit & F.coalesce("right", F.lit(False))).alias("right"), F.count_if(hit).alias("reports"))


# --- units, intervals and comparisons ----------------------------------------------------------------------------------


def error_units(rows: DataFrame, keep: Callable[[Column], Column] | None = None, *by: str) -> DataFrame:
    """``speaker, found, errors`` over labelled words, counting only the expert errors ``keep`` selects."""
    kept = F.filter("expert_errors", keep) if keep else F.col("expert_errors")
    each = rows.where("expert_wrong is not null").select("speaker", *by, kept.alias("k"), "our_errors")
    return each.groupBy(*by, "speaker").agg(F.sum(found_errors(F.col("k"), F.col("our_errors"))).alias("found"), F.sum(F.size("k")).alias("errors"))


def catch_units(rows: DataFrame) -> DataFrame:
    """``name, speaker, found, errors`` of labelled Turkish words for all errors and each reported pattern, in one pass."""
    is_tip = lambda t: lambda e: F.coalesce(e["tip"] == t, F.lit(False))
    keeps = {"errors": lambda e: F.lit(True), **{t: is_tip(t) for t in CAUGHT_PATTERNS}, "z_to_s": lambda e: F.coalesce((e["expected"] == "z") & (e["heard"] == "s"), F.lit(False))}
    found = lambda keep: F.struct(found_errors(F.filter("expert_errors", keep), F.col("our_errors")).alias("found"), F.size(F.filter("expert_errors", keep)).alias("errors"))
    named = F.array(*[F.struct(F.lit(n).alias("name"), found(k).alias("x")) for n, k in keeps.items()])
    each = rows.where(_LABELLED).select("speaker", F.explode(named).alias("u"))
    return each.groupBy(F.col("u.name").alias("name"), "speaker").agg(F.sum("u.x.found").alias("found"), F.sum("u.x.errors").alias("errors"))


def detection_with_intervals(rows: DataFrame, labels: dict[str, str], n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """By label version and group: counts, rates, speakers, and intervals of the rates over resampled speakers.

    labels: column of each version; a null label leaves the word out. rows: speaker, grp, flagged and the labels.
    """
    versions = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("wrong")) for v, c in labels.items()])
    each = rows.select("speaker", "grp", "flagged", F.explode(versions).alias("v")).select("speaker", "grp", "flagged", "v.*")
    units = M.confusion(each, F.col("wrong"), F.col("flagged"), "version", "grp", "speaker")
    sums = {c: F.sum(c) for c in ("tp", "fp", "fn", "tn")}
    whole = M.with_rates(units.groupBy("version", "grp").agg(*[x.alias(c) for c, x in sums.items()], F.count("*").alias("speakers")))
    tp, fp, fn, tn = sums.values()
    rates = {"false_alarm": M.ratio(fp, fp + tn), "recall": M.ratio(tp, tp + fn), "precision": M.ratio(tp, tp + fp), "f1": M.ratio(2 * tp, 2 * tp + fp + fn)}
    return whole.join(resampling.bootstrap_by(units, ["version", "grp"], "speaker", rates, n_resamples, seed), ["version", "grp"])


def compare_systems(a: DataFrame, b: DataFrame, n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Differences b - a of every metric over the speakers both systems have, with paired intervals, in one job.

    Both: ``metric, statistic, speaker, x0, x1, x2, x3``: tp, fp, fn, tn, or for the statistic ``catch`` found and errors.
    """
    columns = ("x0", "x1", "x2", "x3")
    named = lambda df, p: df.select("metric", "statistic", "speaker", *[F.col(c).alias(f"{p}{c}") for c in columns])
    both = named(a, "a").join(named(b, "b"), ["metric", "statistic", "speaker"])

    def value(p: str) -> Column:
        tp, fp, fn, tn = (F.sum(f"{p}{c}") for c in columns)
        rates = {"recall": M.ratio(tp, tp + fn), "precision": M.ratio(tp, tp + fp), "f1": M.ratio(2 * tp, 2 * tp + fp + fn), "false_alarm": M.ratio(fp, fp + tn), "catch": M.ratio(tp, fp)}
        kind = F.first("statistic")
        return F.coalesce(*[F.when(kind == n, x) for n, x in rates.items()])

    gap = value("b") - value("a")
    whole = both.groupBy("metric").agg(F.count("*").alias("speakers"), value("a").alias("a"), value("b").alias("b"), gap.alias("diff"))
    ci = resampling.bootstrap_by(both, ["metric"], "speaker", {"diff": gap}, n_resamples, seed)
    return whole.join(ci, "metric").withColumn("real", (F.col("diff_low") > 0) | (F.col("diff_high") < 0))


def reproduced(saved: DataFrame, now: DataFrame) -> bool:
    """Whether two tables have the same rows."""
    now = now.select(*saved.columns)
    return saved.exceptAll(now).isEmpty() and now.exceptAll(saved).isEmpty()


# --- sentences and recognisers -----------------------------------------------------------------------------------------


def canonical_bias(rows: DataFrame, recognized: str, heard: str, expected: str, *by: str) -> DataFrame:
    """Phone error rates of what was recognised against what was heard and what was expected, and their gap: positive
    for a recogniser that writes what should have been said."""
    edits = lambda a, b: F.levenshtein(*P.as_symbols(F.col(a), F.col(b)))
    rate = lambda a: M.ratio(F.sum(edits(a, recognized)), F.sum(F.size(a)))
    out = rows.groupBy(*by).agg(F.count("*").alias("recordings"), rate(heard).alias("per_vs_heard"), rate(expected).alias("per_vs_expected"))
    return out.withColumn("gap", F.col("per_vs_heard") - F.col("per_vs_expected"))


def recognizer_report(rows: DataFrame) -> DataFrame:
    """By first language and for all (null): sentences, error rates and detection of mispronunciations. rows: l1,
    expected, perceived, recognized, function."""
    counted = rows.withColumn("_c", sequences.mdd_counts(F.col("expected"), F.col("perceived"), F.col("recognized"), F.col("function")))
    edits = lambda a: F.levenshtein(*P.as_symbols(F.col(a), F.col("recognized")))
    rate = lambda a: M.ratio(F.sum(edits(a)), F.sum(F.size(a)))
    sums = [F.sum(f"_c.{c}").alias(c) for c in ("ta", "fr", "fa", "tr", "diagnosed")]
    return M.with_mdd_rates(counted.rollup("l1").agg(F.count("*").alias("sentences"), rate("perceived").alias("per"), rate("expected").alias("per_vs_expected"), *sums))


def focus_catch(rows: DataFrame, pairs: Sequence[tuple[str, str]] = FOCUS) -> DataFrame:
    """For typical errors that the annotator heard: how many the recogniser noticed at all, and how many it named."""
    states = sequences.phone_states(F.col("expected"), F.col("perceived"), F.col("recognized"), F.col("function"))
    sounds = rows.withColumn("_s", states).select(F.explode(F.arrays_zip("expected", F.col("_s.annotated").alias("annotated"), F.col("_s.predicted").alias("predicted"))).alias("x")).select("x.*")
    wanted = rows.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "expected string, annotated string, ordinal int")
    found = sounds.where("annotated is not null").groupBy("expected", "annotated").agg(F.count("*").alias("errors"), F.count("predicted").alias("detected"), F.count_if(F.col("predicted") == F.col("annotated")).alias("diagnosed"))
    return F.broadcast(wanted).join(found, ["expected", "annotated"], "left").na.fill(0, ["errors", "detected", "diagnosed"])


def error_report(rows: DataFrame) -> dict[str, DataFrame]:
    """Of annotated sentences (a manifest): totals, errors by kind, by pattern, the 20 most frequent pairs and typical pairs."""
    errors = rows.select("id", F.posexplode("errors").alias("_i", "e")).select("id", "_i", F.col("e")[0].alias("kind"), F.col("e")[3].alias("tip"), P.pair_label(F.col("e")[1], F.col("e")[2]).alias("pair"))
    order = errors.withColumn("_order", F.struct("id", "_i"))
    pairs = rows.sparkSession.createDataFrame([(f"{a} → {b}", i) for i, (a, b) in enumerate(TYPICAL_PAIRS)], "pair string, ordinal int")
    counted = errors.groupBy("pair").agg(F.count("*").alias("n"))
    return {
        "totals": rows.agg(F.count("*").alias("sentences"), F.round(F.sum("seconds") / 3600, 2).alias("hours"), F.sum(F.size("errors")).alias("errors"), F.count_if(F.size("errors") > 0).alias("sentences_with_errors")),
        "by_kind": errors.groupBy("kind").agg(F.count("*").alias("n")),
        "tips": errors.where("tip is not null").groupBy("tip").agg(F.count("*").alias("n")),
        "top_pairs": M.top_k(order, "pair", "_order", 20).select("pair", "n"),
        "typical": F.broadcast(pairs).join(counted, "pair", "left").na.fill(0, ["n"]),
    }


# --- examples ----------------------------------------------------------------------------------------------------------


def _changed(a: DataFrame, b: DataFrame, group: str, wrong: bool) -> DataFrame:
    before = a.select("speaker", "word_idx", F.col("flagged").alias("_was"))
    return b.join(before, ["speaker", "word_idx"]).where((F.col("grp") == group) & (F.col("expert_wrong") == wrong) & ~F.col("_was") & F.col("flagged")).drop("_was")


def new_catches(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """At most n Turkish errors that only b reports, exactly as the expert heard them: one for each preferred pair first,
    then others in order. ``place`` orders them.

    A word can serve one pair only, so of each pair the first words are taken (at most as many as there are pairs) and
    dealt on the driver.
    """
    exact = F.filter("expert_errors", lambda e: F.exists("our_errors", lambda o: o["kind"].eqNullSafe(e["kind"]) & o["expected"].eqNullSafe(e["expected"]) & o["heard"].eqNullSafe(e["heard"])))
    found = _changed(a, b, "turkish", True).select("speaker", "word_idx", F.transform(exact, lambda e: F.concat_ws(">", e["expected"], e["heard"])).alias("pairs")).where(F.size("pairs") > 0)
    names = [f"{x}>{y}" for x, y in PREFERRED]
    by_pair = found.withColumn("pair", F.explode(F.array_intersect("pairs", F.array(*map(F.lit, names)))))
    first = by_pair.withColumn("_k", F.row_number().over(Window.partitionBy("pair").orderBy("speaker", "word_idx"))).where(F.col("_k") <= len(names)).drop("_k").orderBy("speaker", "word_idx").collect()
    chosen: list[tuple] = []
    for name in names:
        free = [(r.speaker, r.word_idx) for r in first if r.pair == name and (r.speaker, r.word_idx) not in chosen]
        chosen += free[: min(1, n - len(chosen))]
    rest = [(r.speaker, r.word_idx) for r in found.orderBy("speaker", "word_idx").limit(n + len(chosen)).collect()]
    chosen += [x for x in rest if x not in chosen][: n - len(chosen)]
    picked = b.sparkSession.createDataFrame([(s, w, i) for i, (s, w) in enumerate(chosen)], f"speaker {dict(b.dtypes)['speaker']}, word_idx {dict(b.dtypes)['word_idx']}, place int")
    return b.join(F.broadcast(picked), ["speaker", "word_idx"])


def new_false_alarms(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """The first n native words said right that only b reports."""
    return _changed(a, b, "english", False).orderBy("speaker", "word_idx").limit(n)
