"""Joins by place, by time and by key that the evaluation needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.operators.windows import nearest_known


def positional_join(left: DataFrame, right: DataFrame, key: str, place: str) -> DataFrame:
    """Rows at the same place of groups that have as many rows on both sides; other groups are left out whole."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    equal = count(left, "_l").join(count(right, "_r"), key).where("_l = _r").select(key)
    return left.join(equal, key, "left_semi").join(right, [key, place])


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """Points with the interval of their key that they lie in, or else the nearest (the earlier of two as near, also where they
    share a border); ``distance`` is 0 inside. Points without a time, and those of keys without intervals, have none.

    Intervals of a key must not overlap. Points and starts are put in one order by key and time and take the last start before
    and the first one from there on (``windows.nearest_known``): no pairs are made, and a key with many rows is in many tasks.
    """
    marks = intervals.select(key, F.col(start).alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(name).alias("n")).alias("_own"))
    # a point comes before an interval that starts with it: the interval before may end there
    both = points.withColumns({"_t": F.col(at), "_kind": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    both = nearest_known(both, F.col("_own"), [key], ["_t", "_kind"], "_b", "_a").where("_kind = 0")
    before, after = F.greatest(F.lit(0), F.col(at) - F.col("_b.e")), F.col("_a.s") - F.col(at)
    first = F.col("_a").isNull() | (F.col("_b").isNotNull() & (before <= after))
    known = F.col(at).isNotNull() & (F.col("_a").isNotNull() | F.col("_b").isNotNull())
    found = {name: F.when(known, F.when(first, F.col("_b.n")).otherwise(F.col("_a.n"))), "distance": F.when(known, F.when(first, before).otherwise(after))}
    return both.withColumns(found).drop("_t", "_kind", "_own", "_b", "_a")


def paired(rows: DataFrame, keys: list[str], version: str, value: Column, versions: tuple[str, str]) -> DataFrame:
    """One row for each key with the value of both versions (null where one is missing), in one aggregation."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(version) == v, value)).alias(v) for v in versions])


def in_fixed_order(summary: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of an ordered dimension with their summary; missing ones are null."""
    return order.join(summary, key, "left")


def missing_keys(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(known, keys, "left_anti")


def only_known_tokens(rows: DataFrame, tokens: str, vocabulary: Column) -> DataFrame:
    return rows.where(F.size(F.array_except(tokens, vocabulary)) == 0)


def assert_disjoint(rows: DataFrame, locked: DataFrame, key: str) -> None:
    """Raises PermissionError if a locked key is among the rows."""
    if not rows.join(locked, key, "left_semi").isEmpty():
        raise PermissionError(f"locked {key} in the data")
