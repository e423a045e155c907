"""Evaluation put together, on small tables."""

import pytest
from pyspark.sql import functions as F
from tests.test_assessment import V, frames

from phonolith.operators import evaluation, resampling, selection, sequences, windows
from phonolith.plans import coach

ISSUE = "struct<kind:string,expected:string,heard:string,tip:string,hidden:boolean>"


def test_archive_words_join_expert_and_system(spark):
    words, raw = ["think", "bad"], [["θ", "ɪ", "ŋ", "k"], ["b", "æ", "d"]]
    heard = spark.createDataFrame([("turkish1", "[tɪŋk bæd]"), ("english2", "[θɪŋk]"), ("alone3", "[θɪŋk bæd]")], "speaker string, text string")
    spoken = [("turkish1", ["t", "ɪ", "ŋ", "k", "b", "æ", "d"]), ("english2", ["θ", "ɪ", "ŋ", "k", "b", "æ", "t"])]
    rows = [(s, words, raw, frames(said).ravel().tolist(), 1.0) for s, said in spoken]
    found = sequences.analyze(spark.createDataFrame(rows, "speaker string, words array<string>, raw array<array<string>>, log_probs array<double>, seconds double"), V, gop=None)
    out = {(r.speaker, r.word_idx): r for r in evaluation.archive_words(heard, found, words, raw).collect()}
    assert len(out) == 4 and {r.grp for r in out.values()} == {"turkish", "english"}
    one = out["turkish1", 0]
    assert one.expert_wrong and one.expert_wrong_raw and one.flagged and one.expert_tips == one.our_tips == ["th_voiceless"] and one.expert_pairs == one.our_pairs == ["θ → t"]
    assert not out["turkish1", 1].expert_wrong and not out["english2", 0].flagged
    skipped = out["english2", 1]
    assert skipped.expert_wrong is None and skipped.expert_phones is None and skipped.our_tips == ["final_voicing"]


def test_catch_of_errors(spark):
    made = spark.sql(f"""SELECT cast(a AS array<{ISSUE}>) AS expert_errors, cast(b AS array<{ISSUE}>) AS our_errors FROM VALUES
      (array(struct('sub', 'w', 'v', 'w', false), struct('sub', 'w', 'β', 'w', false)), array(struct('sub', 'w', 'v', 'w', false))),
      (array(struct('ins', null, 'ɪ', 'epenthesis', false), struct('del', 't', null, null, false)), array(struct('ins', null, 'i', null, false), struct('sub', 't', 'd', null, false))),
      (array(), array(struct('sub', 'w', 'v', 'w', false))) AS t(a, b)""")
    r = evaluation.error_level_catch(made).first()
    assert (r.expert_errors, r.found, r.found_exact, r.multi_error_words, r.multi_all, r.multi_some, r.multi_none) == (4, 3, 1, 2, 1, 1, 0)
    assert r.catch == 0.75 and r.exact == 0.25
    assert {x.tip: (x.errors, x.found) for x in evaluation.catch_by_tip(made).collect()} == {"w": (2, 2), "epenthesis": (1, 1)}
    assert evaluation.error_level_catch(made.limit(0)).first().catch == 0.0


def test_utterances_of_other_lengths_are_left_out(spark):
    ours = spark.sql(f"SELECT 1 AS id, array(named_struct('score', 1.0D, 'issues', cast(array() AS array<{ISSUE}>)), named_struct('score', 0.5D, 'issues', cast(array(struct('sub', 'w', 'v', 'w', false)) AS array<{ISSUE}>))) AS words")
    ours = ours.unionByName(ours.withColumn("id", F.lit(2)))
    human = spark.sql("SELECT id, 's' AS speaker, slice(array(named_struct('text', 'a', 'accuracy', 10), named_struct('text', 'b', 'accuracy', 4)), 1, n) AS words FROM VALUES (1, 2), (2, 1) AS t(id, n)")
    rows = evaluation.scored_words(ours, human, ["id"])
    assert [(r.accuracy, r.our_score, r.flagged, r.pairs) for r in rows.collect()] == [(10, 1.0, False, []), (4, 0.5, True, ["w → v"])]
    found = evaluation.word_detection(rows).first()
    assert (found.tp, found.fp, found.fn, found.tn) == (1, 0, 0, 1) and found.pcc == pytest.approx(1)


def test_nineteen_metrics_in_order(spark):
    units = [(u, f"s{k}", 8 - k, k, 2, 9, 1) for u in {m[1] for m in evaluation.COMPARED} for k in range(5)]
    a = spark.createDataFrame([x[:6] for x in units], "units string, speaker string, x0 int, x1 int, x2 int, x3 int")
    b = a.withColumn("x0", F.col("x0") + 1).where("units <> 'saa_dev_w'")
    out = evaluation.compare_experiments(a, b, n_resamples=50).orderBy("ordinal").collect()
    assert len(evaluation.COMPARED) == 19 and len(out) == 18 and [r.metric for r in out] == [m[0] for m in evaluation.COMPARED if m[1] != "saa_dev_w"]
    assert all(r.diff > 0 for r in out if r.metric.endswith(("recall", "precision", "F1"))) and all(r.diff == 0 for r in out if "false alarm" in r.metric and "Kokoro" not in r.metric)


def test_selection_on_development_speakers(spark):
    rows = [("turkish" if k % 2 else "english", f"{k % 2}{k % 24}", (k % 10) / 10, k % 10 > 6 and k % 2 == 1, False) for k in range(2400)]
    made = spark.createDataFrame(rows, "grp string, speaker string, p double, wrong boolean, extra boolean")
    found = evaluation.select_on_dev(made.withColumn("p", F.when(F.col("grp") == "english", F.col("p") / 10).otherwise(F.col("p"))), 4)
    assert tuple(found["thresholds"].first()) == (0.7, 0.7)
    assert {r.grp: (r.recall, r.false_alarm) for r in found["held_out"].collect()} == {"turkish": (1.0, 0.0), "english": (0.0, 0.0), "turkish_red": (1.0, 0.0)}
    worse = {**found, "held_out": found["held_out"].withColumn("recall", F.lit(0.5))}
    assert evaluation.best_label({"strict": worse, "loose": found}) == "loose" and evaluation.best_label({"a": found, "b": found}) == "a"
    assert found["average_precision"].first().ap == pytest.approx(1)


def test_manifests_count_reasons(spark):
    label = "struct<canonical:string,perceived:string,kind:string,accented:boolean,unsure:boolean>"
    made = spark.sql(f"""SELECT id, cast(words AS array<struct<text:string,phones:array<{label}>>>) AS words, raw, 1.5D AS seconds FROM VALUES
      ('kept', array(struct('the', array(struct('DH', 'D', 'sub', false, false), struct('AH0', 'AH0', 'correct', false, false)))), array(array('ð', 'ə'))),
      ('unsure', array(struct('b', array(struct('B', null, 'sub', false, true)))), array(array('b'))),
      ('unknown', array(struct('zoo', array(struct('Z', 'Z', 'correct', false, false), struct('UW1', 'UW1', 'correct', false, false)))), array(array('z', 'uː'))),
      ('label', null, array(array('z'))) AS t(id, words, raw)""")
    rows, reasons = evaluation.manifest(made, ["ð", "ə", "d", "b"])
    assert {r.reason: r.n for r in reasons.collect()} == {"kept": 1, "err label": 1, "token not in vocab": 1, "bad label": 1}
    [r] = rows.collect()
    assert (r.id, r.text, r.tokens, r.canonical, r.expected, r.perceived, r.function, r.seconds) == ("kept", "the", "d ə", ["ð", "ə"], ["ð", "ə"], ["d", "ə"], [True, True], 1.5)
    assert r.errors == [["sub", "ð", "d", "th_voiced"]]
    native = spark.createDataFrame([("a", ["the", "zoo"], [["ð", "ə"], ["z"]]), ("b", ["the"], [["ð", "ə"]])], "id string, words array<string>, raw array<array<string>>")
    rows, reasons = evaluation.native_manifest(native, ["ð", "ə"])
    assert {r.reason: r.n for r in reasons.collect()} == {"kept": 1, "token not in vocab": 1} and [(r.id, r.l1, r.tokens, r.perceived, r.function, r.errors) for r in rows.collect()] == [("b", "English", "ð ə", ["ð", "ə"], [True, True], [])]


def test_balanced_samples_repeat_rows(spark):
    rows = spark.createDataFrame([("many" if k else "one", k) for k in range(50)], "label string, id int")
    out = resampling.balanced_sample(rows, "label", "id", 1000, 1).collect()
    assert len(out) == 1000 == len({r.draw for r in out}) and 350 < sum(r.label == "one" for r in out) < 650
    assert len({r.id for r in out}) > 40 and sorted(map(tuple, out)) == sorted(map(tuple, resampling.balanced_sample(rows, "label", "id", 1000, 1).collect()))


def test_margins_are_those_of_trying_each(spark):
    """Against applying every setting to all words."""
    rows = []
    for k in range(1200):
        group, wrong = ("turkish", "english")[k % 2], k % 5 == 0 if k % 11 else None
        rivals = [{"pos": j % 2, "expected": "w", "tip": ("w", "v", "ae")[(k + j) % 3], "sound": "v", "margin": float(-((k * 7 + j * 3) % 6) - (0 if wrong else 2))} for j in range(k % 4)]
        errors = [{"kind": "sub", "expected": "w", "heard": "v", "tip": ("w", "v")[k % 3 > 0], "hidden": False}] if wrong else []
        ours = [{"kind": "del", "expected": "t", "heard": None, "tip": None, "hidden": False}] if k % 17 == 0 else []
        rows.append((group, f"{group}{k % 9}", wrong, ours, errors, rivals))
    made = spark.createDataFrame(rows, f"grp string, speaker string, expert_wrong boolean, our_errors array<{ISSUE}>, expert_errors array<{ISSUE}>, rivals array<struct<pos:int,expected:string,tip:string,sound:string,margin:double>>")
    grid, limits = [0.0, -1.0, -2.0, -3.0, -5.0], {"min_precision": 0.3, "max_false_alarm": 0.9, "min_diagnosis": 0.1, "min_reports": 10}
    want = dict.fromkeys(["w", "v", "ae"])
    for tip in want:
        for value in sorted(grid):
            out = selection.apply_hidden(made, {**want, tip: value})
            right, n = selection.diagnosis_precision(out, tip)
            s = selection.scores(out).first()
            if n >= 10 and right >= 0.1 * n and s.precision >= 0.3 and s.english_false_alarm <= 0.9:
                want[tip] = value
                break
    assert selection.select_hidden(made, grid, list(want), **limits) == want and any(v is not None for v in want.values())


def test_places_in_groups_and_means_over_blocks(spark):
    rows = spark.createDataFrame([(None if k % 3 == 0 else k % 3, k, float(k * k % 17)) for k in range(300)], "g int, k int, v double")
    out = windows.numbered_within(rows, ["g"], ["k"], "place", "size").collect()
    assert all(r.place == r.k // 3 and r.size == 100 for r in out) and len(out) == 300
    means = {r.k: r.moving for r in windows.moving_mean(rows, ["g"], ["k"], "v", 4, block=7).collect()}
    value = {r.k: r.v for r in rows.collect()}
    assert means == {k: pytest.approx(sum(value[k - 3 * j] for j in range(4)) / 4) for k in range(9, 300)}


def test_words_outside_the_lexicon_can_be_a_column(spark):
    lexicon = spark.createDataFrame([("the", ["ð", "ə"])], "word string, phones array<string>")
    said = spark.createDataFrame([(1, "The zebra the yak"), (2, "the"), (3, None)], "id int, text string")
    out = {r.id: r for r in coach.phonemized(said, lexicon, ["id"], strict=False).collect()}
    assert out[1].unknown == ["zebra", "yak"] and out[1].raw == [["ð", "ə"], [], ["ð", "ə"], []] and out[2].unknown == [] and out[3].raw == []
