"""Sentence scorer and error detector on Spark ML: candidates by cross-validation, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.operators.metrics import auc_and_ap
from phonolith.sources.store import once

ALPHAS = [10.0 ** (k / 2) for k in range(-6, 7)]
#: Rounds of boosting; stopping early is for the caller, who knows the size of the table.
ROUNDS = 300
#: Rows of a task in training.
TASK_ROWS = 1 << 19
#: Rows of a table that is trained on as it is, and points of a task where equal rows are merged.
SMALL, TASK_POINTS = 10_000, 1 << 16


def fold_of(group: str, n_folds: int):
    """A fold number by group (speaker), so none is on both sides."""
    return F.pmod(F.xxhash64(group), F.lit(n_folds)).cast("int")


def spread(rows: DataFrame) -> DataFrame:
    """Rows in tasks of at most about ``TASK_ROWS``: dealt anew if a task holds more, as it may where files are large."""
    held = rows.groupBy(F.spark_partition_id().alias("_task")).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return rows if (held["most"] or 0) <= TASK_ROWS else rows.repartition(-(-held["all"] // TASK_ROWS))


def points_of(rows: DataFrame, columns: list[str]) -> int | None:
    """About how many distinct values of ``columns`` the rows have, where it pays to merge rows of equal values: trees see no
    difference between equal rows and one with their number as its weight. None where few are equal, or few rows are there."""
    found = rows.agg(F.count("*").alias("all"), F.approx_count_distinct(F.xxhash64(*columns)).alias("points")).first()
    return found["points"] if found["all"] > max(SMALL, 2 * found["points"]) else None


def dealt(points: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """About ``n`` points in tasks of at most about ``TASK_POINTS``, each in one task and place in every run: Spark ML draws the
    bins of a feature from rows by their places."""
    return points.repartition(-(-n // TASK_POINTS), *columns).sortWithinPartitions(*columns)


def products(rows: DataFrame, columns: list[str], by: str, weight: str | None = None, within: str | None = None) -> dict[int, np.ndarray]:
    """For each fold the sums of products of all columns and 1, in one aggregation: all that least squares needs. A row counts as
    ``weight`` ones, whose last columns have ``within`` as the sum of their squared differences from the row's."""
    times, more = F.col(weight) if weight else F.lit(1.0), F.col(within) if within else F.lit(0.0)
    named = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    pairs = [(i, j) for i in range(len(named)) for j in range(i + 1)]
    each = {(i, j): times * named[i] * named[j] + (more if i == j == len(columns) else F.lit(0.0)) for i, j in pairs}
    out = {}
    for r in rows.groupBy(by).agg(*[F.sum(each[i, j]).alias(f"p{i}_{j}") for i, j in pairs]).collect():  # one row for each fold
        out[r[by]] = np.zeros((len(named), len(named)))
        for i, j in pairs:
            out[r[by]][i, j] = out[r[by]][j, i] = r[f"p{i}_{j}"]
    return out


def ridge(sums: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights of a ridge on standardised columns, from sums of products whose last column is the target."""
    n, mean = sums[0, 0], sums[0] / sums[0, 0]
    centred = sums[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    sd = np.sqrt(np.maximum(np.diag(centred)[:-1] / n, 0))
    sd[sd == 0] = 1.0
    z = centred[:-1, :-1] / np.outer(sd, sd)
    w = np.linalg.lstsq(z + alpha * np.eye(len(sd)), centred[:-1, -1] / sd, rcond=None)[0] / sd
    return np.array([mean[-1] - w @ mean[1:-1], *w])


def r_squared(sums: np.ndarray, weights: np.ndarray) -> float:
    """R2 of a linear model on the rows behind the sums."""
    beta = np.array([*weights, -1.0])
    total = sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0]
    return float(1 - beta @ sums @ beta / total) if total > 0 else 0.0


@dataclass
class Linear:
    """A linear model as an expression of the row."""

    features: list[str]
    weights: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        terms = [F.col(f).cast("double") * float(w) for f, w in zip(self.features, self.weights[1:], strict=True)]
        return rows.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(float(self.weights[0]))))


def fit_scorer(rows: DataFrame, features: list[str], label: str, group: str, n_folds: int = 3, rounds: int = ROUNDS) -> tuple[object, dict[str, float]]:
    """The best of three candidates by cross-validated R2 (one-feature baseline apart), and each one's value. Rows with a
    null among the features or label don't count.

    The linear ones, every penalty and fold come from one aggregation; only the trees need passes of their own. Rows of equal
    features and fold are one point with their mean label, their number as its weight and their squared differences from the
    mean, if that leaves far fewer: sums of squares, trees and R2 are those of the rows.
    """
    rows = rows.withColumn("_fold", fold_of(group, n_folds)).select(*features, label, "_fold").na.drop()
    alike = [*features, "_fold"]
    if n := points_of(rows, alike):
        merged = rows.groupBy(*alike).agg(F.avg(F.col(label).cast("double")).alias(label), F.count("*").cast("double").alias("_weight"), (F.var_pop(label) * F.count("*")).alias("_within"))
        data = once(dealt(merged, n, alike))
    else:
        data = once(spread(rows).withColumns({"_weight": F.lit(1.0), "_within": F.lit(0.0)}))
    folds = products(data, [*features, label], "_fold", "_weight", "_within")
    every = sum(folds.values())

    def validated(columns: list[int], alpha: float) -> float:
        pick = np.ix_(columns, columns)
        return float(np.mean([r_squared(own[pick], ridge((every - own)[pick], alpha)) for own in folds.values()]))

    whole = list(range(len(features) + 2))
    alpha = max(ALPHAS, key=lambda a: validated(whole, a))
    trees = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), GBTRegressor(featuresCol="x", labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=3, seed=1)])

    def held_out(fold: int) -> float:
        scored = trees.fit(data.where(F.col("_fold") != fold)).transform(data.where(F.col("_fold") == fold))
        missed = scored.agg(F.sum(F.col("_weight") * (F.col(label) - F.col("prediction")) ** 2 + F.col("_within"))).first()[0]
        total = folds[fold][-1, -1] - folds[fold][0, -1] ** 2 / folds[fold][0, 0]
        return float(1 - missed / total) if total > 0 else 0.0

    on_session = inheritable_thread_target(data.sparkSession)
    with ThreadPoolExecutor(n_folds + 1) as pool:
        of_all = pool.submit(on_session(trees.fit), data)
        by_trees = float(np.mean(list(pool.map(on_session(held_out), folds))))
    quality = {"baseline": validated([0, 1, len(features) + 1], 0.0), "ridge": validated(whole, alpha), "trees": by_trees}
    best = Linear(features, ridge(every, alpha)) if quality["ridge"] >= quality["trees"] else of_all.result()
    return best, quality


def score(model, rows: DataFrame, low: float = 0.0, high: float = 10.0) -> DataFrame:
    return model.transform(rows).withColumn("score", F.greatest(F.lit(low), F.least(F.lit(high), F.col("prediction")))).drop("x", "prediction")


class Detector:
    """Error probability of each sound: boosted trees on imputed features with missing-value flags, isotonic calibration."""

    def __init__(self, features: list[str], group: str, n_folds: int = 3, seed: int = 1, rounds: int = ROUNDS) -> None:
        self.features, self.group, self.n_folds, self.seed, self.rounds = features, group, n_folds, seed, rounds

    def _flagged(self, rows: DataFrame) -> DataFrame:
        clean = {f: F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double")) for f in self.features}
        return rows.withColumns(clean).withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in self.features})

    def fit(self, rows: DataFrame, label: str) -> Detector:
        """Rows of equal features, fold and label are one weighted point, if that leaves far fewer."""
        data = self._flagged(rows.select(*dict.fromkeys([*self.features, self.group, label]))).withColumn("_fold", fold_of(self.group, self.n_folds)).withColumn("_label", F.col(label).cast("double"))
        filled = [f"{f}_filled" for f in self.features]
        prepare = Pipeline(stages=[Imputer(inputCols=self.features, outputCols=filled), VectorAssembler(inputCols=filled + [f"{f}_missing" for f in self.features], outputCol="x")])
        prepared = prepare.fit(data.where("_fold <> 0"))
        alike = [*self.features, "_fold", "_label"]
        if n := points_of(data, alike):
            points = self._flagged(dealt(data.groupBy(*alike).agg(F.count("*").cast("double").alias("_weight")), n, alike))
        else:
            points = spread(data).withColumn("_weight", F.lit(1.0))
        # every round reads the assembled points, not the source
        ready = once(prepared.transform(points).select("x", "_label", "_fold", "_weight"))
        trees = GBTClassifier(featuresCol="x", labelCol="_label", weightCol="_weight", maxIter=self.rounds, maxDepth=3, seed=self.seed).fit(ready.where("_fold <> 0"))
        self.model = PipelineModel([prepared, trees])
        held = trees.transform(ready.where("_fold = 0")).withColumn("raw", vector_to_array("probability")[1])
        # one weighted point for each value: ties don't meet in a task
        points = held.groupBy("raw").agg((F.sum(F.col("_label") * F.col("_weight")) / F.sum("_weight")).alias("_label"), F.sum("_weight").alias("_weight"))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="_label", weightCol="_weight", predictionCol="calibrated").fit(points)
        return self

    def probabilities(self, rows: DataFrame) -> DataFrame:
        raw = self.model.transform(self._flagged(rows)).withColumn("raw", vector_to_array("probability")[1])
        return self.calibration.transform(raw).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def permuted(rows: DataFrame, features: list[str], member: str, n_repeats: int = 5, seed: int = 0, group_size: int = 1000) -> DataFrame:
    """Rows as they are (``_feature`` null, ``_repeat`` 0), and for every feature and repeat once more with the values of that feature
    moved to other rows of a random group of about ``group_size`` rows.

    Python returns each row once, with the values that it gets from others in arrays; the copies are made of them in the JVM, where they
    are scored. No task holds more than a group in Python, and none puts all rows in an order.
    """
    groups = rows.count() // group_size + 1
    columns = rows.columns

    def moved(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        own = table.drop_columns(["_group"]).take(pc.sort_indices(table.drop_columns(["_group"]), [(member, "ascending")]))
        n = own.num_rows
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * n_repeats)
        for k, f in enumerate(features):
            places = np.stack([np.random.default_rng([seed, group, k, repeat]).permutation(n) for repeat in range(n_repeats)], 1)
            own = own.append_column(f"_moved{k}", pa.ListArray.from_arrays(offsets, own.column(f).combine_chunks().take(pa.array(places.ravel()))))
        return own

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.col(member), F.lit(seed)), F.lit(groups)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{n}` {t}" for n, t in types.items()), *(f"_moved{k} array<{types[f]}>" for k, f in enumerate(features))])
    which = [(-1, 0), *((k, repeat) for k in range(len(features)) for repeat in range(n_repeats))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("repeat")) for k, r in which]))
    copies = dealt.groupBy("_group").applyInArrow(moved, schema).withColumn("_copy", each)
    values = {f: F.when(F.col("_copy.k") == k, F.get(f"_moved{k}", F.col("_copy.repeat"))).otherwise(F.col(f)) for k, f in enumerate(features)}
    named = F.get(F.array(*[F.lit(f) for f in features]), F.nullif(F.col("_copy.k"), F.lit(-1)))
    return copies.select(*[values.get(c, F.col(c)).alias(c) for c in columns], named.alias("_feature"), F.col("_copy.repeat").alias("_repeat"))


def importance(probabilities: Callable[[DataFrame], DataFrame], rows: DataFrame, features: list[str], label: str, member: str, n_repeats: int = 5, seed: int = 0, top: int | None = None) -> DataFrame:
    """``feature, mean, std``, the most important first (the ``top`` ones): how much average precision falls when a feature's values
    are permuted. ``probabilities`` adds ``p``; ``member`` tells rows apart.

    All features and repeats are scored in one job, and one aggregation gives a precision for each.
    """
    scored = probabilities(permuted(rows, features, member, n_repeats, seed)).select("_feature", "_repeat", "p", F.col(label).alias("_label"))
    found = {(r["_feature"], r["_repeat"]): float(r.ap) for r in auc_and_ap(scored, "p", F.col("_label"), "_feature", "_repeat").collect()}  # one row for each feature and repeat
    drops = {f: [found[None, 0] - found[f, k] for k in range(n_repeats)] for f in features}
    ranked = sorted(((f, float(np.mean(d)), float(np.std(d))) for f, d in drops.items()), key=lambda x: -x[1])
    return rows.sparkSession.createDataFrame(ranked[:top], "feature string, mean double, std double")
