"""Margins of patterns, intervals of areas under curves, and systems from files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.operators import alignment, margins, resampling, sequences
from phonolith.operators import kernels as K
from phonolith.plans import coach
from tests.test_assessment import V, frames


def plain_auc(rows, weight):
    """rows: (unit, score, wrong)."""
    won = pos = neg = 0.0
    for u, x, wrong in rows:
        if not wrong:
            neg += weight[u]
            continue
        pos += weight[u]
        won += weight[u] * sum(weight[v] * ((y < x) + (y == x) / 2) for v, y, other in rows if not other)
    return won / (pos * neg) if pos * neg else None


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_intervals_by_group(spark, monkeypatch, cells):
    rng = random.Random(1)
    rows = [(g, rng.choice("abcde"), float(rng.randrange(8)), rng.random() < 0.3) for g in ("x", "y", None) for _ in range(60)] + [("one class", "a", 1.0, True), ("x", "a", None, True)]
    df = spark.createDataFrame(rows, "g string, unit string, score double, wrong boolean").repartition(3)
    monkeypatch.setattr(resampling._rank_sums, "__defaults__", (cells,))
    got = {r.g: r for r in resampling.auc_interval(df, "unit", "score", F.col("wrong"), 50, by=["g"]).collect()}
    assert got["one class"].auc is None and got["one class"].low is None
    for g in ("x", "y", None):
        own = [r[1:] for r in rows if r[0] == g and r[2] is not None]
        units = sorted({r[0] for r in own})
        drawn = []
        for b in range(50):
            weight = dict.fromkeys(units, 0)
            for slot in range(len(units)):
                weight[units[int(resampling._mixed(b, slot, 1)) % len(units)]] += 1
            drawn.append(plain_auc(own, weight))
        low, high = np.percentile([x for x in drawn if x is not None], [2.5, 97.5])
        assert (got[g].auc, got[g].low, got[g].high) == (pytest.approx(plain_auc(own, dict.fromkeys(units, 1))), pytest.approx(low), pytest.approx(high))


def test_labels_of_sounds():
    # an expert's word against the expected one: pattern's error, other error, right, skipped
    margin = lambda place, tip: {"place": place, "tip": tip, "margin": -1.0, "greedy_expected": True}
    week = ("week", ["w", "iː", "k"])
    own = [margin(0, "w"), margin(0, None), margin(1, "long_ee")]
    words = [(*week, ["v", "iː", "k"], own), (*week, ["b", "ɪ", "k"], own), (*week, ["w", "iː", "k"], own), (*week, None, own), (*week, ["v", "ɪ", "k"], own)]
    label = [[(x["pattern"], x["label"]) for x in w] for w in K.sound_labels(words, [True, True, True, True, False])]
    assert label == [[("w", 1), (None, 1), ("long_ee", 0)], [("long_ee", 1)], [("w", 0), (None, 0), ("long_ee", 0)], [], [(None, 1)]]


def test_margins_of_every_sound_and_tables(spark):
    raw = [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]]
    said = {"turkish1": "θ ɪ ŋ k b æ t", "turkish2": "s ɪ ŋ k b æ d", "english1": "θ ɪ ŋ k b æ d"}
    heard = {"turkish1": [raw[0], ["b", "æ", "t"]], "turkish2": [["t", "ɪ", "ŋ", "k"], raw[1]], "english1": [raw[0], None]}
    rows = [(s, ["think", "bad"], raw, frames(x.split(), rival=("s", 0.2)).ravel().tolist(), 1.0, heard[s]) for s, x in said.items()]
    df = spark.createDataFrame(rows, "speaker string, words array<string>, raw array<array<string>>, log_probs array<double>, seconds double, expert array<array<string>>")
    native = F.col("speaker").startswith("english")
    items = margins.labelled_sounds(sequences.analyze(df, V, margins=True), ["speaker"], F.col("expert"), ~native)
    got = {(r.speaker, r.word, r.place, r.pattern): (r.label, r.greedy_expected) for r in items.collect()}
    assert got["turkish1", 1, 2, "final_voicing"] == (1, False) and got["turkish2", 0, 0, "th_voiceless"] == (1, False) and got["english1", 0, 0, "th_voiceless"] == (0, True)
    assert ("english1", 1, 2, "final_voicing") not in got
    table = {r.pattern: r for r in margins.in_pattern_order(margins.pattern_margins(margins.sound_items(items), "speaker", native, 20)).collect()}
    assert (table["th_voiceless"].errors, table["th_voiceless"].right_turkish, table["th_voiceless"].right_native, table["th_voiceless"].missed) == (1, 1, 1, 0)
    assert table["w"].errors == 0 and table["w"].auc is None and len(table) == 14 and table["th_voiceless"].auc == 1.0


def test_the_rule_of_the_hidden_w(spark):
    rows = [("turkish1", -1.0, 1), ("turkish1", -5.0, 0), ("turkish2", -2.0, 1), ("english1", -6.0, 0)]
    items = spark.createDataFrame([(s, 0, 0, None, y, m, True) for s, m, y in rows], "speaker string, word int, place int, pattern string, label int, margin double, greedy_expected boolean")
    row = margins.w_rule(margins.w_items(items), "speaker", F.col("speaker").startswith("english"), 20).first()
    assert (row.errors, row.right_turkish, row.right_native, row.errors_median, row.auc) == (2, 1, 1, -1.5, 1.0)


FILES = {
    "plain": {"name": "plain", "recognizer": "m", "decision": "rules", "settings": {"gop_threshold": -2.5, "pattern_threshold": -1.0}},
    "general": {"name": "general", "recognizer": "m", "decision": "rules", "settings": {"gop_threshold": 0.0, "pattern_threshold": float("inf"), "hidden_thresholds": {"th_voiceless": -4.0, "w": None, "ng": None}}},
    "off": {"name": "off", "settings": {"gop_threshold": None}},
    "bare": {"name": "bare"},
}


def test_systems_from_files(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    read = {name: coach.load_system(spark, str(tmp_path / f"{name}.json")) for name in FILES}
    assert read["general"].settings == {"gop": 0.0, "pattern": float("inf"), "hidden": {"th_voiceless": -4.0, "w": None, "ng": None}} and read["off"].settings == {"gop": None} and read["bare"].settings == {}
    lp = frames(["θ", "ɪ", "ŋ", "k", "b", "æ", "t"], rival=("s", 0.2)).ravel().tolist()
    df = spark.createDataFrame([(1, ["think", "bad"], [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]], lp, 1.0)], "id int, words array<string>, raw array<array<string>>, log_probs array<double>, seconds double")
    issues = {n: [[(i.expected, i.heard, i.hidden) for i in w.issues] for w in s.assess(df, V, ["id"]).first().words] for n, s in read.items()}
    assert issues["plain"] == issues["off"] == issues["bare"] == [[], [("d", "t", False)]]
    assert issues["general"] == [[("θ", "s", True)], [("d", "t", False)]]
    for bad, error, match in (({"name": "x", "decision": "guess"}, ValueError, "unknown decision"), ({"name": "x", "settings": {"gop": 1}}, ValueError, "unknown settings"), ({"name": "x", "decision": "detector", "settings": {"detector": "d"}}, KeyError, "d")):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(error, match=match):
            coach.load_system(spark, str(tmp_path / "bad.json"))
    learned = object()
    (tmp_path / "bad.json").write_text(json.dumps({"name": "x", "decision": "detector", "settings": {"detector": "d"}}))
    assert coach.load_system(spark, str(tmp_path / "bad.json"), {"d": learned}).settings["detector"] is learned


def test_costs_with_flags_in_the_jvm(spark):
    rows = [(["ʊ", "t"], ["ə", "s", "b"], [True, False]), (["ʊ"], [], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, f array<boolean>")
    got = df.select(sequences.edit_cost(sequences.align(F.col("a"), F.col("b"), F.col("f")), F.col("f")).alias("c")).collect()
    assert [r.c for r in got] == [pytest.approx(K.edit_cost(o, f)) for o, (_, _, f) in zip(alignment.align_many([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]), rows, strict=True)]
