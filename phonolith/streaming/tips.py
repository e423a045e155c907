"""Running tip counts of learners as recordings arrive: a stateless analysis and one small keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tip_counts(analyzed: DataFrame, learner: str, time: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Reported tips by learner and window of a stream of analysed utterances; state older than the watermark goes."""
    tips = analyzed.withWatermark(time, late).select(learner, time, F.explode(F.flatten(F.transform("words", lambda w: w["issues"]))).alias("i")).where("i.tip is not null")
    return tips.groupBy(F.window(time, window), learner, F.col("i.tip").alias("tip")).agg(F.count("*").alias("n"))
