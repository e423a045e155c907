"""Bootstrap intervals, paired comparisons and splits by seeded integer hashes, the same on every engine and rerun."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolith.operators.windows import joined, numbered, numbered_within

_PRIME = 2147483647


def draw(replicate: Column, slot: Column, n: Column, seed: int) -> Column:
    """A number in [0, n) for a replicate and slot."""
    x = F.pmod(replicate * 1103515245 + slot * 12345 + seed * 69069, F.lit(_PRIME))
    return F.pmod(F.pmod(x * 48271, F.lit(_PRIME)), n)


def resample(units: DataFrame, unit: str, n_resamples: int, seed: int) -> DataFrame:
    """For every replicate as many units as there are, drawn with replacement: ``replicate`` and the units' columns.

    Units (speakers, not rows) are numbered in the order of their key; the draws are made where they are joined.
    """
    placed = numbered(units, "_place", "_n", unit)
    draws = placed.select(F.col("_place").alias("_slot"), "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_resamples - 1).cast("bigint"))).alias("replicate"))
    return draws.select("replicate", draw(F.col("replicate"), F.col("_slot"), F.col("_n"), seed).alias("_place")).join(placed.drop("_n"), "_place").drop("_place")


def resample_within(units: DataFrame, by: list[str], unit: str, n_resamples: int, seed: int) -> DataFrame:
    """Like ``resample()`` for the units of each group on their own, all groups in one job."""
    placed = numbered_within(units, by, [unit], "_place", "_n")
    replicates = F.sequence(F.lit(0).cast("bigint"), F.lit(n_resamples - 1).cast("bigint"))
    draws = placed.select(*by, F.col("_place").alias("_slot"), "_n", F.explode(replicates).alias("replicate"))
    picked = draws.select(*by, "replicate", draw(F.col("replicate"), F.col("_slot"), F.col("_n"), seed).alias("_place"))
    return picked.join(placed.drop("_n"), [*by, "_place"]).drop("_place")


def bootstrap_by(units: DataFrame, by: list[str], unit: str, statistics: dict[str, Column], n_resamples: int = 2000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """For each group the interval of every statistic, all over the same draws: by, ``<name>_low``, ``<name>_high``."""
    tail = (1 - level) / 2
    each = resample_within(units, by, unit, n_resamples, seed).groupBy(*by, "replicate").agg(*[s.cast("double").alias(n) for n, s in statistics.items()])
    ends = [F.percentile(n, F.lit(q)).alias(f"{n}_{e}") for n in statistics for e, q in (("low", tail), ("high", 1 - tail))]
    return each.groupBy(*by).agg(*ends)


def _mixed(b, slot, seed):
    """The number that ``draw()`` takes a remainder of."""
    return ((b * 1103515245 + slot * 12345 + seed * 69069) % 2147483647) * 48271 % 2147483647


def _rank_sums(batch: pa.Table, n_resamples: int, seed: int, cells: int = 1 << 22) -> list[np.ndarray]:
    """Of one group's counts in one range of scores, for the table and every resample: wins inside the range, and the weights of
    both classes. Rows are ascending by score."""
    x, k, p, n = (batch.column(c).to_numpy() for c in ("_x", "_k", "p", "n"))
    n_units, total = int(batch.column("_units")[0].as_py()), n_resamples + 1
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    out = [np.zeros(total) for _ in range(3)]
    # as many draws at a time as keep units x draws and rows x draws within the bound
    step = max(1, cells // max(n_units, len(x)))
    for at in range(0, total, step):
        own = _weights(n_units, seed, at, min(at + step, total))[k]
        pos, neg = np.add.reduceat(p[:, None] * own, starts), np.add.reduceat(n[:, None] * own, starts)
        below = np.cumsum(neg, 0) - neg
        for sums, value in zip(out, (pos * (below + neg / 2), pos, neg), strict=True):
            sums[at : at + step] = value.sum(0)
    return out


def _weights(n_units: int, seed: int, start: int, end: int) -> np.ndarray:
    """How often each unit (by place) is drawn in some resamples; column 0 of all is the table itself, each unit once."""
    columns = []
    for c in range(start, end):
        columns.append(np.ones(n_units) if c == 0 else np.bincount(_mixed(c - 1, np.arange(n_units), seed) % n_units, minlength=n_units).astype(float))
    return np.stack(columns, 1)


def auc_interval(rows: DataFrame, unit: str, score: str, wrong: Column, n_resamples: int = 2000, seed: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """``by, auc, low, high``: area under the ROC curve of a score and its interval over resampled speakers (units) of each group.
    Resamples of one class are skipped; null without both classes.

    Rows become counts for each speaker and score. A resample is a weight of each speaker, which any task can compute from the
    speaker's place, so a range of scores is added up for all resamples at once, and one row of sums for each range and group
    is all that is left to put together.
    """
    wanted = list(by)
    by = wanted or ["_one"]
    rows = rows.withColumn("_wrong", wrong).where(F.col(score).isNotNull() & F.col("_wrong").isNotNull())
    steps = (rows if wanted else rows.withColumn("_one", F.lit(0))).groupBy(*by, unit, F.col(score).cast("double").alias("_x")).agg(F.count_if("_wrong").alias("p"), F.count_if(~F.col("_wrong")).alias("n"))
    units = numbered_within(steps.select(*by, unit).distinct(), by, [unit], "_k", "_units")
    placed = joined(steps, units, [*by, unit]).select(*by, "_x", "_k", "_units", "p", "n")
    dealt = placed.repartitionByRange(*by, "_x").sortWithinPartitions(*by, "_x")
    fields = [f for f in placed.schema if f.name in by]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table, part = pa.Table.from_batches(held), TaskContext.get().partitionId()
        own = list(zip(*(table.column(c).to_pylist() for c in by), strict=True))
        cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = _rank_sums(table.slice(a, b - a), n_resamples, seed)
            yield pa.RecordBatch.from_arrays([*(table.column(c).slice(a, 1).combine_chunks() for c in by), pa.array([part]), *(pa.array([v], pa.list_(pa.float64())) for v in found)], [*by, "_range", "won", "pos", "neg"])

    def ends(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_range").to_numpy())
        won, pos, neg = (np.stack([np.asarray(v, float) for v in table.column(c).to_pylist()])[order] for c in ("won", "pos", "neg"))
        below = np.cumsum(neg, 0) - neg
        both = pos.sum(0) * neg.sum(0)
        auc = np.divide((won + pos * below).sum(0), both, out=np.full(len(both), np.nan), where=both > 0)
        drawn = auc[1:][~np.isnan(auc[1:])]
        low, high = np.percentile(drawn, [2.5, 97.5]) if len(drawn) and not np.isnan(auc[0]) else (None, None)
        found = [None if np.isnan(auc[0]) else float(auc[0]), low, high]
        return pa.table([*(table.column(c).slice(0, 1) for c in by), *(pa.array([v], pa.float64()) for v in found)], [*by, "auc", "low", "high"])

    each = dealt.mapInArrow(sums, f"{keys}, _range bigint, won array<double>, pos array<double>, neg array<double>")
    out = each.groupBy(*by).applyInArrow(ends, f"{keys}, auc double, low double, high double")
    return out.select(*wanted, "auc", "low", "high")


def bootstrap_ci(units: DataFrame, unit: str, statistic: Column, n_resamples: int = 2000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """``low, high``: the interval of an aggregate over resampled units."""
    tail = (1 - level) / 2
    each = resample(units, unit, n_resamples, seed).groupBy("replicate").agg(statistic.cast("double").alias("s"))
    return each.agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, unit: str, statistic: Callable[[str], Column], n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Difference of a statistic between two systems over the same draws: ``diff, low, high, real`` (the interval
    excludes 0). ``statistic("a")`` is the aggregate over the columns ``a_...`` of the first system's units. Raises
    ValueError unless both systems have the same units."""
    rename = lambda df, p: df.select(unit, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != unit])
    both = rename(a, "a").join(rename(b, "b"), unit)
    if len({a.count(), b.count(), both.count()}) > 1:
        raise ValueError("the systems have different units")
    gap = (statistic("b") - statistic("a")).cast("double")
    each = resample(both, unit, n_resamples, seed).groupBy("replicate").agg(gap.alias("s"))
    ci = each.agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))
    return both.agg(gap.alias("diff")).crossJoin(ci).withColumn("real", (F.col("low") > 0) | (F.col("high") < 0))


def stratified_split(rows: DataFrame, strata: list[str], member: str, order: Column, share: float) -> DataFrame:
    """Rows with ``held_out``: in each stratum the first ``share`` of its members (rounded half to even) by ``order``."""
    placed = numbered_within(rows.withColumn("_order", order), strata, ["_order", member], "_place", "_n")
    return placed.withColumn("held_out", F.col("_place") < F.bround(F.col("_n") * share, 0)).drop("_order", "_place", "_n")


def halves(rows: DataFrame, strata: list[str], order: list[str], coin: Column) -> DataFrame:
    """Rows with ``half``: neighbours in each stratum's order form pairs, the coin of a pair's first row deals them."""
    rows = numbered_within(rows, strata, order, "_place", "_n").withColumn("_pair", F.floor(F.col("_place") / 2))
    flip = F.first(coin).over(Window.partitionBy(*strata, "_pair").orderBy("_place"))
    return rows.withColumn("half", F.when((F.col("_place") % 2 == 0) == flip, "dev").otherwise("test")).drop("_place", "_n", "_pair")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``: all classes weigh the same together."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    n_classes = counts.agg(F.count("*").alias("_k"))
    return rows.join(counts.crossJoin(n_classes), label).withColumn("weight", 1.0 / (F.col("_n") * F.col("_k"))).drop("_n", "_k")


def pick_per_stratum(rows: DataFrame, strata: list[str], member: str, order: Column, n: int) -> DataFrame:
    """n members of each stratum (all of a smaller one), the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, member))
    return rows.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")


def balanced_draws(rows: DataFrame, label: str, member: str, order: Column, n: int) -> DataFrame:
    """An epoch of about n rows in which every class comes as often: the rows used, with ``copies``.

    Each member of a class gets the whole part of its share of n / classes, and those first by ``order`` one more.
    """
    classes = rows.agg(F.count_distinct(label).alias("_c"))  # one row
    placed = numbered_within(rows.withColumn("_order", order), [label], ["_order", member], "_k", "_n").drop("_order").crossJoin(F.broadcast(classes))
    quota = F.floor(F.lit(n) / F.col("_c"))
    copies = F.floor(quota / F.col("_n")) + F.when(F.col("_k") < F.pmod(quota, F.col("_n")), 1).otherwise(0)
    return placed.withColumn("copies", copies).where("copies > 0").drop("_k", "_n", "_c")


def balanced_sample(rows: DataFrame, label: str, member: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement (``draw`` from 0): every class is as likely, and every row of a class.

    Rows are numbered in the order of class and member, so those of a class follow each other; a draw picks a class, then a
    place in it. rows: each member once.
    """
    placed = numbered(rows, "_place", "_rows", label, member).drop("_rows")
    sizes = placed.groupBy(label).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    classes = sizes.withColumns({"_class": (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"), "_classes": F.count("*").over(Window.partitionBy())}).drop(label)
    count = classes.agg(F.count("*").alias("_c"))  # one row; classes are few
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(count)).withColumn("_class", draw(F.col("draw"), F.lit(0), F.col("_c"), seed))
    picked = draws.join(classes, "_class").select("draw", (F.col("_first") + draw(F.col("draw"), F.lit(1), F.col("_size"), seed)).alias("_place"))
    return picked.join(placed, "_place").drop("_place")
