"""Whole runs of two systems on small tables, against counts by hand."""

import pytest
from pyspark.sql import functions as F

from phonolith.plans import coach, experiments
from tests.test_assessment import V, frames

WORDS, RAW = ["think", "bad"], [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]]
UTTERANCE = "words array<string>, raw array<array<string>>, log_probs array<double>, seconds double"
STRICT, PLAIN = coach.System("strict", settings={"gop": -30.0, "pattern": -30.0}), coach.System("plain", settings={"gop": None})


def said(text):
    return WORDS, RAW, frames(text.split()).ravel().tolist(), 1.0


def test_the_archive(spark):
    spoken = {"turkish1": "t ɪ ŋ k b æ t", "turkish2": "θ ɪ ŋ k b æ d", "english1": "θ ɪ ŋ k b æ t", "english2": "θ ɪ ŋ k b æ d"}
    heard = {"turkish1": "[tɪŋk bæt]", "turkish2": "[sɪŋk bæd]", "english1": "[θɪŋk bæd]", "english2": "[θɪŋk bæd]"}
    recordings = spark.createDataFrame([(s, *said(t)) for s, t in spoken.items()], f"speaker string, {UTTERANCE}")
    transcribed = spark.createDataFrame(list(heard.items()), "speaker string, text string")
    runs = [experiments.run_archive(s, recordings, transcribed, V, WORDS, RAW, 50) for s in (STRICT, PLAIN)]
    tables, units = runs[1]
    got = {(r.units, r.speaker): (r.x0, r.x1, r.x2, r.x3) for r in units.collect()}
    assert got["saa_dev_turkish", "turkish1"] == (2, 0, 0, 0) and got["saa_dev_turkish", "turkish2"] == (0, 0, 1, 1) and got["saa_dev_english", "english1"] == (0, 1, 0, 1)
    assert got["saa_dev_turkish_errors", "turkish1"][:2] == (2, 2) and got["saa_dev_th_voiceless", "turkish2"][:2] == (0, 1) and got["saa_dev_final_voicing", "turkish1"][:2] == (1, 1)
    main = {r.grp: r for r in tables["detection"].where("version = 'main'").collect()}
    assert (main["turkish"].tp, main["turkish"].fn, main["english"].fp) == (2, 1, 1)
    assert tables["errors"].first().found == 2 and tables["types"].count() == 3 and {r.grp for r in tables["bias"].collect()} == {"turkish", "english"} and tables["patterns"].count() == 2
    met = {r.name: (r.value, r.met) for r in experiments.targets(units).collect()}
    assert met["turkish_precision"] == (1.0, True) and met["turkish_recall"] == (pytest.approx(2 / 3), True) and met["english_false_alarm"] == (0.25, False) and met["th_voiced_catch"][0] == 0
    gap = {r.metric: r.diff for r in experiments.compare([runs[0][1]], [units], 50).collect()}
    assert gap["SAA dev, Turkish: recall"] == pytest.approx(2 / 3) and gap["SAA dev, English: false alarm"] == 0.25 and len(gap) == 13


def test_scored_sentences(spark):
    recordings = spark.createDataFrame([(1, *said("t ɪ ŋ k b æ d")), (2, *said("θ ɪ ŋ k b æ t"))], f"id int, {UTTERANCE}")
    human = spark.createDataFrame([(1, "s1", [(4.0,), (10.0,)]), (2, "s2", [(10.0,), (8.0,)])], "id int, speaker string, words array<struct<accuracy:double>>")
    tables, units = experiments.run_scored(PLAIN, recordings, human, V, ["id"])
    assert {r.speaker: (r.units, r.x0, r.x1, r.x2, r.x3) for r in units.collect()} == {"s1": ("speechocean_val", 1, 0, 0, 1), "s2": ("speechocean_val", 1, 0, 0, 1)}
    assert tables["expert_below_10"].first().tp == 2 and (tables["expert_below_7"].first().tp, tables["expert_below_7"].first().fp) == (1, 1)


def test_synthetic_pairs(spark):
    rows = [("kokoro", "th_voiceless", "th_voiceless", "think", v, 1.0, version, ["think"], RAW[:1], frames(t.split()).ravel().tolist(), 1.0) for v, version, t in (("a", "correct", "θ ɪ ŋ k"), ("a", "error", "t ɪ ŋ k"), ("b", "correct", "s ɪ ŋ k"), ("b", "error", "θ ɪ ŋ k"), ("c", "error", "s ɪ ŋ k"))]
    recordings = spark.createDataFrame(rows, f"engine string, pattern string, tip string, word string, voice string, speed double, version string, {UTTERANCE}")
    tables, units = experiments.run_synthetic(PLAIN, recordings, V)
    got = {(r.units, r.speaker.split("|")[2]): (r.x0, r.x1) for r in units.collect()}
    assert got == {("synthetic_kokoro_catch", "a"): (1, 1), ("synthetic_kokoro_false_alarm", "a"): (0, 1), ("synthetic_kokoro_catch", "b"): (0, 1), ("synthetic_kokoro_false_alarm", "b"): (1, 1)}
    assert tables["recordings"].where("right_tip").count() == 3 and "ALL" in [r.pattern for r in tables["summary"].where(F.col("pairs") > 0).collect()]
