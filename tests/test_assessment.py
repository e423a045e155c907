"""The learned detector, reports and the coach on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.functions import phones as P
from phonolith.operators import detector, models, reports, resampling, sequences
from phonolith.operators import kernels as K
from phonolith.operators.sounds import sound_measures
from phonolith.plans import coach, planning

V = ["<pad>", "<s>", "</s>", "<unk>", "θ", "ɪ", "ŋ", "k", "t", "s", "b", "æ", "d", "z", "iː"]
E = "array<struct<kind:string,expected:string,heard:string,tip:string,hidden:boolean>>"


def frames(phones, p=0.95, rival=None):
    """Two frames and a blank for each sound; rival: (sound, its probability where a sound is said)."""
    path = [0, *(t for x in phones for t in (V.index(x), V.index(x), 0)), 0]
    probs = np.full((len(path), len(V)), (1 - p) / (len(V) - 1))
    probs[np.arange(len(path)), path] = p
    if rival:
        said = np.array(path) != 0
        probs[said, V.index(rival[0])] = rival[1]
    return np.log(probs / probs.sum(axis=1, keepdims=True))


def analyzed(words, raw, said, **more):
    lp = frames(said, **more)
    return K.analyze(words, raw, lp, V, len(lp) * K.FRAME_SECONDS)


def test_scores_ignore_blocked_sounds():
    lp = frames(["θ", "ɪ", "ŋ", "k"], p=0.5)
    lp[:, 3] = np.log(0.45)  # a token that is never output
    a = K.analyze(["think"], [["θ", "ɪ", "ŋ", "k"]], lp, V, 1.0)
    assert a["heard"] == ["θ", "ɪ", "ŋ", "k"] and max(a["lpr"]) <= 0 and np.allclose(a["lpr"], 0)


def test_sound_measures():
    raw = [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]]
    rows = sound_measures(["think", "bad"], raw, analyzed(["think", "bad"], raw, ["θ", "ɪ", "ŋ", "k", "b", "æ", "t"], rival=("s", 0.2)), V, 0)
    assert [(r["word"], r["place"], r["n"], r["phone"]) for r in rows[:4]] == [(0, i, 4, p) for i, p in enumerate(raw[0])]
    assert [r["kind"] for r in rows] == ["match"] * 6 + ["sub"] and rows[6]["heard"] == "t" and rows[6]["final"] and not rows[0]["final"]
    assert rows[0]["margin_max"] == pytest.approx(math.log(0.2 / 0.95)) and rows[0]["top_other"] == "s" and rows[2]["margin_max"] is None
    assert sum(r["seconds"] for r in rows) == pytest.approx(7 * rows[0]["mean_seconds"])
    none = sound_measures(["bad"], raw[1:], K.analyze(["bad"], raw[1:], frames([]), V, 0.1), V, 0)
    assert [r["lpp"] for r in none] == [None] * 3 and {r["kind"] for r in none} == {"del"}


def recorded(spark):
    rows = [(1, ["think", "bad"], [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]], frames(["θ", "ɪ", "ŋ", "k", "b", "æ", "t"], rival=("s", 0.2)).ravel().tolist(), 1.0), (2, ["sit"], [["s", "ɪ", "t"]], frames(["s", "ɪ", "t"]).ravel().tolist(), 0.5)]
    return spark.createDataFrame(rows, "id int, words array<string>, raw array<array<string>>, log_probs array<double>, seconds double")


def test_features_in_context(spark):
    found = sequences.analyze(recorded(spark), V, sounds=True)
    rows = detector.sound_rows(found, ["id"])
    assert set(detector.FEATURES) - set(rows.columns) == {"lpp_z", "lpr_z"}
    first = [r.asDict() for r in rows.where("id = 1").orderBy("at").collect()]
    assert [r["prev_lpr"] for r in first[1:]] == [r["lpr"] for r in first[:-1]] and first[0]["prev_lpr"] is None and first[-1]["next_lpr"] is None
    assert {r["word_min_lpr"] for r in first[4:]} == {min(r["lpr"] for r in first[4:])}
    assert [r["relative_position"] for r in first[:4]] == pytest.approx([0, 1 / 3, 2 / 3, 1]) and first[6]["op_pattern_sub"] == 1 and first[6]["is_stop"] == 1
    assert first[2]["prev_vowel_duration"] == pytest.approx(first[1]["duration"]) and first[1]["prev_vowel_duration"] is None and first[3]["prev_vowel_duration"] is None
    stats = detector.sound_stats(rows, F.col("kind") == "match", least_rows=2)
    z = {(r.phone, r.id): r for r in detector.standardized(rows, stats).collect()}
    alone = {r.phone: r for r in stats.collect()}
    assert z["k", 1].lpp_z == pytest.approx((z["k", 1].lpp - alone[None].lpp_mean) / alone[None].lpp_std) and alone["ɪ"].n == 2


def test_detector_decides(spark):
    found = sequences.analyze(recorded(spark), V, sounds=True)
    p = detector.sound_rows(found, ["id"]).select("id", "at", F.when((F.col("id") == 1) & (F.col("at") == 0), 0.9).when((F.col("id") == 1) & (F.col("at") == 6), 0.1).otherwise(0.3).alias("p"))
    one, two = detector.decided(found, p, ["id"], red=0.8, yellow=0.5).orderBy("id").collect()
    think, bad = one.words
    assert (think.level, think.error_prob, [(i.expected, i.heard, i.tip) for i in think.issues]) == ("red", 0.9, [("θ", "s", "th_voiceless")])
    assert bad.level is None and not bad.issues and [o.kind for o in bad.ops] == ["match"] * 3 and one.tips == ["th_voiceless"] and two.tips == []


def test_systems_and_coach(spark):
    lexicon = spark.createDataFrame([("think", ["θ", "ɪ", "ŋ", "k"]), ("bad", ["b", "æ", "d"]), ("sit", ["s", "ɪ", "t"])], "word string, phones array<string>")
    spoken = recorded(spark).drop("words", "raw").withColumn("text", F.when(F.col("id") == 1, "Think, bad!").otherwise("Sit."))
    out = {r.id: r for r in coach.Coach(V, lexicon).assess(spoken, ["id"]).collect()}
    assert [w.text for w in out[1].words] == ["Think", "bad"] and out[1].tips == ["final_voicing"] and out[2].phone_accuracy == 1
    with pytest.raises(Exception, match="no words"):
        coach.Coach(V, lexicon).assess(spoken.withColumn("text", F.lit("?!")), ["id"]).collect()
    with pytest.raises(Exception, match="not in the lexicon: zebra"):
        coach.phonemized(spoken.withColumn("text", F.lit("zebra")), lexicon, ["id"]).collect()
    with pytest.raises(ValueError, match="unknown decision"):
        coach.System("x", "guess").assess(spoken, V, ["id"])
    rows = detector.sound_rows(sequences.analyze(recorded(spark), V, sounds=True), ["id"])
    stats = detector.sound_stats(rows, F.lit(True))
    train = detector.standardized(rows, stats).crossJoin(spark.range(12).select(F.concat(F.lit("s"), "id").alias("speaker"))).withColumn("wrong", F.col("op_sub") == 1)
    learned = coach.LearnedDetector(models.Detector(["lpp", "lpr_z", "op_sub"], "speaker", rounds=10).fit(train, "wrong"), stats, "m", {"red": 0.9, "yellow": 0.5})
    by_model = coach.Coach(V, lexicon, "m", detector=learned).assess(spoken, ["id"])
    judged = {r.id: r for r in by_model.collect()}
    assert [w.level for w in judged[1].words] == [None, "red"] and judged[2].words[0].level is None
    assert "error_prob" not in str(coach.Coach(V, lexicon, "other", detector=learned).assess(spoken, ["id"]).schema)
    shown = by_model.select("id", F.transform("words", lambda w: P.level_color(w["level"])).alias("c"), reports.reported_accuracy(F.col("words")).alias("a")).where("id = 1").first()
    rules = spark.range(1).select(*[P.word_color(F.array(*[F.lit("x")] * n), F.lit(s)).alias(f"c{k}") for k, (n, s) in enumerate([(0, 0.1), (1, 0.6), (1, 0.5)])]).first()
    assert tuple(rules) == ("green", "amber", "red") and shown.c == ["green", "red"] and shown.a == pytest.approx(6 / 7)


def issue(kind, e, h, tip=None, hidden=False):
    return (kind, e, h, tip, hidden)


def words_table(spark):
    z = issue("sub", "z", "s", "final_voicing")
    th, r = issue("sub", "θ", "t", "th_voiceless"), issue("sub", "ɹ", "ɾ", "r", True)
    rows = [
        ("t1", 0, "turkish", True, [z, z], [z], []), ("t1", 1, "turkish", True, [th], [], [th]), ("t2", 0, "turkish", True, [th, issue("ins", None, "ɪ", "epenthesis")], [th, issue("ins", None, "ə")], []),
        ("t2", 1, "turkish", False, [], [r], []), ("t3", 0, "turkish", None, [], [r], []), ("e1", 0, "english", False, [], [], []), ("e1", 1, "english", False, [], [issue("del", "t", None)], []), ("e2", 0, "english", True, [z], [z], []),
    ]
    return spark.createDataFrame(rows, f"speaker string, word_idx int, grp string, expert_wrong boolean, expert_errors {E}, our_errors {E}, dismissed {E}").withColumn("flagged", F.size("our_errors") > 0)


def test_found_errors_equals_the_matching(spark):
    rows = words_table(spark)
    key = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["expected"].alias("expected"), x["heard"].alias("heard")))
    both = rows.select(reports.found_errors(F.col("expert_errors"), F.col("our_errors")).alias("a"), sequences.match_errors(key(F.col("expert_errors")), key(F.col("our_errors"))).alias("b")).collect()
    assert [r.a for r in both] == [r.b.found for r in both] == [1, 0, 2, 0, 0, 0, 0, 1]


def test_pattern_reports(spark):
    rows = words_table(spark)
    table = {r.tip: r for r in reports.pattern_table(rows.where("grp = 'turkish' and expert_wrong is not null")).collect()}
    assert set(table) == {"final_voicing", "th_voiceless", "epenthesis"}
    assert tuple(table["th_voiceless"])[2:] == (2, 0.5, 0.5, 2, 0.5, 1) and tuple(table["final_voicing"])[2:] == (1, 1.0, 1.0, 2, 1.0, 0) and table["epenthesis"].right_tip == 0
    stats = {r.tip: r for r in reports.pattern_stats(rows).collect()}
    assert len(stats) == 15 and tuple(stats["r"])[2:] == (0, 0, 1, 0, 1, 0) and tuple(stats["th_voiceless"])[2:] == (2, 1, 1, 1, 0, 0)
    kinds = {r.type: r for r in reports.report_types(rows).collect()}
    assert tuple(kinds["heard pattern"])[1:] == (2, 2, 2, 2, 2, 0, 2) and tuple(kinds["other difference"])[1:] == (1, 1, 1, 1, None, 1, 2) and tuple(kinds["hidden pattern"])[1:] == (1, 0, 1, 0, 0, 0, 2)
    pairs = rows.select("speaker", F.transform("our_errors", lambda i: P.pair_label(i["expected"], i["heard"])).alias("pairs"))
    assert [tuple(r) for r in reports.top_pairs(pairs, "pairs", "speaker", 2).collect()] == [("z → s", 2), ("ɹ → ɾ", 2)]
    w = spark.createDataFrame([("turkish", None, -1.0, [issue("sub", "w", "v", "w")]), ("turkish", False, -3.0, []), ("turkish", True, float("nan"), []), ("english", False, 0.0, [])], f"grp string, expert_wrong boolean, w_margin double, expert_errors {E}")
    assert sorted(map(tuple, reports.hidden_w_precision(w, [-5.0, -2.0]).collect())) == [(-5.0, 1, 2), (-2.0, 1, 1)]


def test_units_and_intervals(spark):
    rows = words_table(spark)
    assert sorted(map(tuple, reports.error_units(rows).collect())) == [("e1", 0, 0), ("e2", 1, 1), ("t1", 1, 3), ("t2", 2, 2)]
    units = {(r.name, r.speaker): (r.found, r.errors) for r in reports.catch_units(rows).collect()}
    assert units["errors", "t1"] == (1, 3) and units["z_to_s", "t1"] == (1, 2) and units["th_voiceless", "t2"] == (1, 1) and units["w", "t1"] == (0, 0)
    both = reports.detection_with_intervals(rows.withColumn("raw", ~F.col("expert_wrong")), {"main": "expert_wrong", "raw": "raw"}, 50)
    main = {(r.version, r.grp): r for r in both.collect()}["main", "turkish"]
    assert (main.tp, main.fp, main.fn, main.tn, main.speakers) == (2, 1, 1, 0, 2) and main.recall_low <= main.recall <= main.recall_high
    a = spark.createDataFrame([("all: recall", "recall", f"s{i}", i % 3, 1, 3, 2) for i in range(9)] + [("all: catch", "catch", f"s{i}", 1, 4, 0, 0) for i in range(9)], "metric string, statistic string, speaker string, x0 long, x1 long, x2 long, x3 long")
    same = {r.metric: r for r in reports.compare_systems(a, a, 50).collect()}
    assert {(r.speakers, r.diff, r.real) for r in same.values()} == {(9, 0.0, False)}
    better = {r.metric: r for r in reports.compare_systems(a, a.withColumn("x0", F.col("x0") + 2), 50).collect()}
    assert better["all: recall"].real and better["all: catch"].diff == pytest.approx(0.5) and better["all: catch"].real
    assert reports.reproduced(a, a) and not reports.reproduced(a, a.limit(3))


def test_auc_interval(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 8}", float(round(rng.normal() + w, 1)), bool(w)) for i in range(200) for w in [int(rng.random() < 0.4)]]
    df = spark.createDataFrame(rows, "speaker string, x double, w boolean")
    r = resampling.auc_interval(df, "speaker", "x", F.col("w"), 60).first()
    pos, neg = ([x for _, x, w in rows if w == v] for v in (True, False))
    assert r.auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) and r.low < r.auc < r.high
    assert resampling.auc_interval(df.where("w"), "speaker", "x", F.col("w"), 20).first().auc is None


def test_draws(spark):
    rows = spark.range(30).select("id", (F.col("id") < 6).alias("native"))
    drawn = resampling.balanced_draws(rows, "native", "id", F.xxhash64("id"), 48).groupBy("native").agg(F.sum("copies").alias("n")).collect()
    assert {r.n for r in drawn} == {24}
    assert {r["count"] for r in resampling.pick_per_stratum(rows, ["native"], "id", F.xxhash64("id"), 5).groupBy("native").count().collect()} == {5}


def test_sentence_reports(spark):
    rows = spark.createDataFrame(
        [("a", "Turkish", ["z", "æ", "t"], ["s", "æ", "t"], ["s", "æ", "t"], [False] * 3, 3600.0, [["sub", "z", "s", "final_voicing"]]), ("b", "Hindi", ["θ", "ɪ"], ["t", "ɪ"], ["θ", "ɪ", "k"], [False] * 2, 1800.0, [["sub", "θ", "t", "th_voiceless"], ["ins", None, "k", None]])],
        "id string, l1 string, expected array<string>, perceived array<string>, recognized array<string>, function array<boolean>, seconds double, errors array<array<string>>",
    )
    by = {r.l1: r for r in reports.recognizer_report(rows).collect()}
    assert (by[None].ta, by[None].fr, by[None].fa, by[None].tr, by[None].diagnosed) == (3, 1, 1, 1, 1) and by[None].per == pytest.approx(2 / 5) and by["Hindi"].recall == 0
    focus = {(r.expected, r.annotated): (r.errors, r.detected, r.diagnosed) for r in reports.focus_catch(rows).collect()}
    assert focus["z", "s"] == (1, 1, 1) and focus["θ", "t"] == (1, 0, 0) and focus["w", "v"] == (0, 0, 0)
    bias = reports.canonical_bias(rows, "recognized", "perceived", "expected").first()
    assert (bias.recordings, bias.per_vs_heard, bias.per_vs_expected) == pytest.approx((2, 2 / 5, 2 / 5)) and bias.gap == pytest.approx(0)
    report = {k: [tuple(r) for r in v.collect()] for k, v in reports.error_report(rows).items()}
    assert report["totals"] == [(2, 1.5, 3, 2)] and dict(report["by_kind"]) == {"sub": 2, "ins": 1} and ("- → k", 1) in report["top_pairs"] and ("z → s", 0, 1) in report["typical"]


def test_examples(spark):
    a, b = words_table(spark).withColumn("flagged", F.lit(False)), words_table(spark)
    assert [(r.speaker, r.word_idx) for r in reports.new_catches(a, b, 3).orderBy("place").collect()] == [("t1", 0), ("t2", 0)]
    assert [(r.speaker, r.word_idx) for r in reports.new_false_alarms(a, b, 5).collect()] == [("e1", 1)]
    labels = spark.createDataFrame([("bad", ["b", "æ", "d"], ["b", "æ", "t"]), ("bad", ["b", "æ", "d"], None)], "w string, e array<string>, h array<string>").select(sequences.expert_label("w", "e", "h").alias("x")).collect()
    assert labels[0].x.wrong is True and labels[0].x.errors[0].tip == "final_voicing" and labels[1].x.wrong is None


def test_synthetic_pairs(spark):
    rows = spark.createDataFrame([("th → t", "error", "TINk"), ("th → t", "correct", "TINk"), ("æ → ɛ", "error", "baId"), ("æ → ɛ", "error", "bad"), ("final devoicing", "error", "bEd"), ("extra vowel before cluster", "error", "sku:l")], "p string, v string, x string")
    assert [r.y for r in rows.select(planning.spoken(F.col("p"), F.col("v"), F.col("x")).alias("y")).collect()] == ["tINk", "TINk", "baId", "bEd", "bEt", "Isku:l"]
    done = [("e", "th → t", "think", v, 1.0, version, flagged, flagged, False) for v, version, flagged in (("a", "correct", False), ("a", "error", True), ("b", "correct", True), ("b", "error", False), ("c", "error", True))]
    results = spark.createDataFrame(done, "engine string, pattern string, word string, voice string, speed double, version string, flagged boolean, right_tip boolean, hidden_by_gop boolean")
    table = {r.pattern: r for r in planning.pair_summary(results).collect()}
    assert len(table) == 13 and (table["ALL"].pairs, table["ALL"].false_alarm, table["ALL"].hidden_by_gop) == (3, 0.5, 0) and table["th → t"].catch == pytest.approx(2 / 3) and table["ŋ + g"].pairs is None
