"""Values carried over ranges of an order: hot keys, borders, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from phonolith.operators import joins, windows


def plain_known(rows):
    """rows: (key, order, value) to {(key, order): (before, after)}."""
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((o, v) for k, o, v in rows if k == key)
        for i, (o, _) in enumerate(own):
            before = [v for _, v in own[:i] if v is not None]
            after = [v for _, v in own[i + 1 :] if v is not None]
            out[key, o] = (before[-1] if before else None, after[0] if after else None)
    return out


def test_nearest_known_with_null_and_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), k, rng.choice([None, None, None, k])) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, place int, value int").repartition(5)
    got = windows.nearest_known(df, F.col("value"), ["key"], ["place"], "before", "after").collect()
    assert {(r.key, r.place): (r.before, r.after) for r in got} == plain_known(rows) and len(got) == len(rows)
    assert windows.nearest_known(df.limit(0), F.col("value"), ["key"], ["place"]).collect() == []


def test_one_key_of_many_rows_is_in_many_tasks(spark):
    n = 1_000_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select(F.lit("hot").alias("key"), F.col("id").alias("place"), F.when(F.col("id") % 250_000 == 7, F.col("id")).alias("value"))
        found = windows.nearest_known(rows, F.col("value"), ["key"], ["place"])
        by_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert max(by_task) < 0.6 * n and sum(by_task) == n
        carried = found.where("place > 7").agg(F.min(F.col("_before") == F.floor((F.col("place") - 8) / 250_000) * 250_000 + 7)).first()[0]
        assert carried is True
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_interval(point, intervals):
    if point is None or not intervals:
        return None, None
    distance = [0.0 if s <= point <= e else min(abs(point - s), abs(point - e)) for s, e, _ in intervals]
    k = distance.index(min(distance))
    return intervals[k][2], distance[k]


def test_intervals_that_share_borders(spark):
    rng = random.Random(2)
    intervals, points = {}, []
    for key in ("a", "b", "hot", "none"):
        edges = sorted(rng.sample(range(100), 8))
        intervals[key] = [] if key == "none" else [(float(s), float(e), f"{key}{s}") for s, e in zip(edges, edges[1:], strict=False) if rng.random() < 0.7]
        points += [(key, rng.choice([None, *(float(x) / 2 for x in range(200))])) for _ in range(400 if key == "hot" else 60)]
    left = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, key string, at double").repartition(4)
    right = spark.createDataFrame([(k, *x) for k, own in intervals.items() for x in own], "key string, s double, e double, word string")
    got = {r.id: (r.word, r.distance) for r in joins.nearest_interval(left, right, "key", "at", "s", "e", "word").collect()}
    assert got == {k: plain_interval(p, intervals[key]) for k, (key, p) in enumerate(points)}


def test_the_earlier_of_two_words_that_meet(spark):
    right = spark.createDataFrame([("k", 1.0, 2.0, "first"), ("k", 2.0, 3.0, "second")], "key string, s double, e double, word string")
    left = spark.createDataFrame([("k", 2.0)], "key string, at double")
    assert joins.nearest_interval(left, right, "key", "at", "s", "e", "word").first().word == "first"


def test_neighbours_of_a_group(spark):
    rows = [("a", k, float(k * k), float(k)) for k in range(50)] + [(None, 1, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "key string, place int, value double, time double").repartition(3)
    got = {(r.key, r.place): r for r in windows.neighbour_features(df, ["key"], ["place"], "value", "time").collect()}
    assert got["a", 3].prev_value == 4.0 and got["a", 3].next_value == 16.0 and got["a", 3].duration == 1.0 and got["a", 49].duration is None
    assert got["a", 0].prev_value is None and got["a", 3].group_min == 0.0 and got["a", 3].duration_rel == pytest.approx(1.0) and got[None, 1].duration_rel is None
