"""Recordings that many texts share: how they meet their texts, and what the analysis returns."""

import numpy as np
from pyspark.sql import functions as F

from phonolith.operators import evaluation, sequences
from phonolith.operators import kernels as K
from phonolith.plans import queries
from tests.test_assessment import V, frames, recorded

SMALLEST = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_dealt_and_not_broadcast(spark):
    rows = queries._recorded(spark, SMALLEST, "p_brand")
    plan = planned(rows)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    dealt = rows.groupBy(F.spark_partition_id()).count().count()
    assert dealt > 1 and rows.count() == spark.read.parquet(f"{SMALLEST}/part.parquet").count()


def test_further_columns_need_no_join_of_matrices(spark):
    assert planned(queries._recorded(spark, SMALLEST, "p_size", "p_brand")).count("Join") == planned(queries._recorded(spark, SMALLEST)).count("Join")


def test_scores_of_experts_are_not_broadcast(spark):
    ours = spark.createDataFrame([(1, [(0.5, [("w", "v")]), (1.0, [])]), (2, [(1.0, [])])], "id int, words array<struct<score:double,issues:array<struct<expected:string,heard:string>>>>")
    human = spark.createDataFrame([(1, "a", [(3.0,), (10.0,)]), (2, "b", [(1.0,), (2.0,)])], "id int, speaker string, words array<struct<accuracy:double>>")
    found = evaluation.scored_words(ours, human, ["id"])
    assert "Broadcast" not in planned(found)
    assert sorted((r.speaker, r.accuracy, r.our_score, r.flagged, len(r.pairs)) for r in found.collect()) == [("a", 3.0, 0.5, True, 1), ("a", 10.0, 1.0, False, 0)]


def test_wanted_results_are_those_of_all(spark):
    every = sequences.analyze(recorded(spark), V, sounds=True)
    some = sequences.analyze(recorded(spark), V, sounds=True, wanted=["sounds", "aligned"])
    assert set(every.columns) - set(some.columns) == {"heard", "words", "features", "tips", "phone_accuracy"}
    assert some.collect() == every.select(*some.columns).collect()


def test_texts_of_one_matrix_are_as_on_their_own():
    one, other = frames(["θ", "ɪ", "ŋ", "k"]), frames(["t", "ɪ", "k"])
    texts = [(["think"], [["θ", "ɪ", "ŋ", "k"]]), (["tick"], [["t", "ɪ", "k"]])]
    given = [(words, raw, m, 1.0) for m in (one, other, one) for words, raw in texts]
    for u, a in zip(given, K.analyze_many(given, V), strict=True):
        alone = K.analyze(*u[:2], u[2].copy(), V, u[3])
        assert (a["heard"], a["words"], a["features"], a["spans"]) == (alone["heard"], alone["words"], alone["features"], alone["spans"])
        assert np.array_equal(a["limited"], alone["limited"])
