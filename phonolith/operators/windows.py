"""Operators over neighbours: repeats, nearest known values, gaps, durations, moving means and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolith.sources.store import once

_BEFORE = (Window.unboundedPreceding, -1)


def collapse_repeats(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in its group."""
    return rows.withColumn("_before", F.lag(value).over(Window.partitionBy(*by).orderBy(order))).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def joined(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary of their keys (null keys are equal), which must have each once; the summary's other columns are added."""
    own = summary.withColumnsRenamed({c: f"_g_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(own[f"_g_{c}"]) for c in keys])
    return rows.join(own, same, "left").drop(*[f"_g_{c}" for c in keys])


def nearest_known(rows: DataFrame, value: Column, by: list[str], order: list[str], before: str = "_before", after: str = "_after") -> DataFrame:
    """Rows with the last value before each in its group, and the first one after it, that isn't null.

    Rows are dealt by ranges of group and order, so a large group lies in many ranges. What is known inside a range comes from a
    window; what an earlier (later) range has last (first) known of the same group is carried on over one row for each range and
    group, and only to groups in more than one range.
    """
    dealt = once(rows.withColumn("_value", value).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *by)
    # a frame that grows is read once, one that shrinks anew for every row; so the value after is the one before in reversed order
    back = own.orderBy(*[F.desc_nulls_last(c) for c in order])
    inside = dealt.withColumns({before: F.last("_value", ignorenulls=True).over(own.orderBy(*order).rowsBetween(*_BEFORE)), after: F.last("_value", ignorenulls=True).over(back.rowsBetween(*_BEFORE))})
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = dealt.groupBy("_range", *by).agg(F.max_by("_value", place).alias("_last"), F.min_by("_value", place).alias("_first"))
    across = Window.partitionBy(*by)
    carried = ends.select(
        "_range", *by, F.count("*").over(across).alias("_ranges"),
        F.last("_last", ignorenulls=True).over(across.orderBy("_range").rowsBetween(*_BEFORE)).alias("_carried"), F.last("_first", ignorenulls=True).over(across.orderBy(F.desc("_range")).rowsBetween(*_BEFORE)).alias("_coming"),
    ).where("_ranges > 1").drop("_ranges")
    both = joined(inside, carried, ["_range", *by])
    return both.withColumns({before: F.coalesce(before, "_carried"), after: F.coalesce(after, "_coming")}).drop("_value", "_range", "_carried", "_coming")


def assign_insertions(rows: DataFrame, by: list[str], order: list[str], word: str, to_next: Column) -> DataFrame:
    """``target``: the word of a row, or for rows without one the word before, unless ``to_next`` holds and the next
    word is another; at the ends the only neighbour."""
    rows = nearest_known(rows, F.col(word), by, order)
    between = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after").isNull() | (F.col("_before") == F.col("_after")), F.col("_before"))
    return rows.withColumn("target", F.coalesce(F.col(word), between, F.when(to_next, F.col("_after")).otherwise(F.col("_before")))).drop("_before", "_after")


def neighbour_features(rows: DataFrame, by: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """Values before and after, the time to the next row, that time relative to the group's mean, and the group's worst. Neighbours
    come from ranges of the order and groups are summed before they are joined, so a large group is in no single task."""
    rows = nearest_known(rows, F.struct(F.col(value).alias("v"), F.col(time).alias("t")), by, order)
    rows = rows.withColumns({"prev_value": F.col("_before.v"), "next_value": F.col("_after.v"), "duration": F.col("_after.t") - F.col(time)}).drop("_before", "_after")
    whole = rows.groupBy(*by).agg(F.min(value).alias("group_min"), F.avg("duration").alias("_mean"))
    return joined(rows, whole, by).withColumn("duration_rel", F.try_divide(F.col("duration"), F.col("_mean"))).drop("_mean")


def moving_mean(rows: DataFrame, by: list[str], order: list[str], value: str, n: int, block: int = 10_000) -> DataFrame:
    """Mean of each row and the n - 1 before it, where there are as many.

    Groups are cut into blocks; the last n - 1 rows of a block are in the next one too, so no task holds a whole group.
    """
    block = max(block, n)
    placed = numbered_within(rows, by, order, "_place", "_size")
    own, late = F.floor(F.col("_place") / block), F.col("_place") % block > block - n
    dealt = placed.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*by, "_block").orderBy("_place").rowsBetween(1 - n, 0)
    means = dealt.withColumn("moving", F.avg(value).over(window)).where((F.floor(F.col("_place") / block) == F.col("_block")) & (F.col("_place") >= n - 1))
    return means.drop("_place", "_size", "_block")


def deal_folds(rows: DataFrame, group: str, member: str, n_folds: int) -> DataFrame:
    """``group, member, fold``: the members of each group dealt round-robin in order."""
    members = numbered_within(rows.select(group, member).distinct(), [group], [member], "_place", "_size")
    return members.select(group, member, F.pmod("_place", F.lit(n_folds)).cast("int").alias("fold"))


def running_offset(size: Column, by: list[str], order: str) -> Column:
    """Sum of the sizes of the rows before."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(order).rowsBetween(*_BEFORE)), F.lit(0))


def numbered(rows: DataFrame, name: str, total: str, *order: str) -> DataFrame:
    """Rows with their place (from 0) in the order of all rows, and the number of rows.

    Rows are dealt by ranges of the order and numbered inside each; only the ranges' sizes, one row for each, are put in
    a row. The ranges are stored, so that places and sizes are of the same ones.
    """
    dealt = once(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_range", running_offset(F.col("_size"), [], "_range").alias("_before"), F.sum("_size").over(Window.partitionBy()).alias(total))
    place = (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).cast("bigint")
    return dealt.withColumn(name, place).join(offsets, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def numbered_within(rows: DataFrame, by: list[str], order: list[str], name: str, total: str) -> DataFrame:
    """Rows with their place (from 0) in their group, and the group's number of rows: places among all rows in the order
    of group and ``order``, less that of the group's first row, so a large group is spread over many tasks."""
    placed = numbered(rows, name, "_all", *by, *order).drop("_all")
    groups = placed.groupBy(*by).agg(F.min(name).alias("_first"), F.count("*").alias(total))
    return joined(placed, groups, by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")
