"""Training and importance on tables of any size: what a task holds, and what leaves Python."""

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from phonolith.operators import models


def test_large_tasks_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    dealt = models.spread(spark.range(1000).coalesce(1))
    assert dealt.count() == 1000 and dealt.rdd.getNumPartitions() == 10
    small = spark.range(90).coalesce(1)
    assert models.spread(small) is small


def test_training_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    kept = []
    monkeypatch.setattr(models, "once", lambda df: kept.append(df) or df)
    rows = spark.range(400).coalesce(1).select((F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 50).alias("speaker"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 2 == 0).alias("wrong"))
    models.fit_scorer(rows, ["f"], "y", "speaker", rounds=1)
    found = models.Detector(["f"], "speaker", rounds=1).fit(rows, "wrong")
    assert [df.rdd.getNumPartitions() for df in kept] == [4, 4]
    # weighted points calibrate as all rows do
    held = found.model.stages[1].transform(kept[1].where("_fold = 0")).withColumn("raw", models.vector_to_array("probability")[1])
    every = IsotonicRegression(featuresCol="raw", labelCol="_label", predictionCol="all").fit(held)
    assert np.allclose(every.boundaries, found.calibration.boundaries) and np.allclose(every.predictions, found.calibration.predictions)


def test_copies_are_made_outside_python(spark):
    rows = spark.range(50).select("id", (F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("b"))
    made = models.permuted(rows, ["a", "b"], "id", n_repeats=3, seed=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate explode") < plan.index("FlatMapGroupsInArrow")  # the copies are above Python
    found = {}
    for r in made.collect():
        found.setdefault((r["_feature"], r["_repeat"]), {})[r.id] = (r.a, r.b)
    own = {k: (k * 1.5, k % 7 if k % 4 else None) for k in range(50)}
    want = {(None, 0): own}
    for k, f in enumerate("ab"):
        for repeat in range(3):
            moved = np.random.default_rng([2, 0, k, repeat]).permutation(50).tolist()
            want[f, repeat] = {i: (own[moved[i]][0], own[i][1]) if f == "a" else (own[i][0], own[moved[i]][1]) for i in range(50)}
    assert found == want
