"""Training on points of equal rows gives the models of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolith.operators import models


def sounds(spark):
    """20,000 rows of 30 x 5 values, some missing or NaN in the second column."""
    rows = spark.range(0, 20_000, 1, 4).select("id", (F.pmod(F.xxhash64("id"), F.lit(30)) * 0.1).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).alias("v"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(40)).alias("speaker"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000).alias("noise"))
    b = F.when(F.col("v") < 5, F.col("v").cast("double")).when(F.col("v") == 5, F.lit(float("nan")))
    y = F.col("a") * F.coalesce("v", F.lit(0)) + F.sin("a") + 3 * F.col("noise")
    return rows.select("a", b.alias("b"), "speaker", y.alias("y"), (y > 6 + F.col("noise")).alias("wrong"))


def test_equal_rows_are_trained_on_once(spark, monkeypatch):
    rows, kept, found = sounds(spark), [], []
    once = models.once
    monkeypatch.setattr(models, "once", lambda df: kept.append(once(df)) or kept[-1])
    whole = rows.na.drop()
    for small in (10_000, 1 << 40):  # merged, and as they are
        monkeypatch.setattr(models, "SMALL", small)
        model, quality = models.fit_scorer(rows, ["a", "b"], "y", "speaker", rounds=3)
        made = models.Detector(["a", "b"], "speaker", rounds=3).fit(rows, "wrong")
        points = rows.select("a", "b").distinct().orderBy("a", "b")
        found.append((quality, [r.prediction for r in model.transform(points.na.drop()).orderBy("a", "b").collect()], [(r.raw, r.p) for r in made.probabilities(points).orderBy("a", "b").collect()]))
    (quality, predicted, p), (quality_of_rows, predicted_of_rows, p_of_rows) = found
    assert quality == pytest.approx(quality_of_rows) and quality["trees"] > quality["ridge"] > 0.5
    assert predicted == pytest.approx(predicted_of_rows) and len(predicted) == 150
    assert np.allclose(p, p_of_rows) and len(p) == 30 * 7 and np.ptp([x[1] for x in p]) > 0.5
    scorer, detector, scorer_of_rows, detector_of_rows = kept
    assert scorer_of_rows.count() == whole.count() > 10_000 and detector_of_rows.count() == 20_000
    assert scorer.count() == 30 * 5 * 3 and detector.count() <= 30 * 6 * 3 * 2
    assert scorer.agg(F.sum("_weight")).first()[0] == whole.count() and detector.agg(F.sum("_weight")).first()[0] == 20_000


def test_points_are_spread(spark, monkeypatch):
    assert models.points_of(sounds(spark), ["y"]) is None and models.points_of(sounds(spark).limit(9000), ["a"]) is None
    assert models.points_of(sounds(spark), ["a"]) == pytest.approx(30, abs=4)
    monkeypatch.setattr(models, "TASK_POINTS", 100)
    first, second = (models.dealt(spark.range(1000).repartition(k), 950, ["id"]) for k in (3, 8))
    assert first.rdd.getNumPartitions() == 10 and first.collect() == second.collect() and {r.id for r in first.collect()} == set(range(1000))
