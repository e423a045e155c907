"""Centroid clustering of whole-number vectors with metric trees that each partition builds of its own rows.

A node of a tree is a ball: its centre, radius, number of vectors and their exact integer sum. A round sends the centroids
to all trees; a ball whose every vector must be nearer to one centroid than to any other, by the triangle inequality, adds
its count and sum to that centroid at once, and any other ball passes the centroids still in question to its two halves, down
to leaves where distances are computed exactly. Only counts and sums leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolith.llm import words as W
from phonolith.llm.store import written

DIMENSIONS, CENTROIDS, ROUNDS = 64, 16, 3
#: Vectors of one tree and of a leaf.
TREE, LEAF = 4096, 24
#: Components saturate here, so that every squared distance fits 64 bits.
MOST = 1 << 24
_NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("right", "<i4"), ("radius", "<f8")])
_TREES = "vec_ids array<bigint>, points binary, nodes binary, centres binary, sums binary"


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, point``: the vectors of exactly ``dimensions`` finite components, each x as floor(64 * x)."""
    good = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 64, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int"))
    return embeddings.where(good).select("vec_id", whole.alias("point"))


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree of the rows of ``points``: their order, the nodes (a node's left half comes next after it, ``right`` is 0 in a
    leaf), centres and sums of the nodes. Halves are cut at the median of the component that varies most."""
    order, nodes, centres, sums = np.arange(len(points)), [], [], []
    stack: list[tuple[int, int, int]] = [(0, len(points), -1)]
    while stack:
        start, end, parent = stack.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        own = points[order[start:end]]
        total = own.sum(0, dtype=np.int64)
        centre = total / (end - start)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        me = len(nodes)
        nodes.append([start, end, 0, radius])
        centres.append(centre)
        sums.append(total)
        if end - start > LEAF and radius > 0:
            dim = int((own.max(0) - own.min(0)).argmax())
            order[start:end] = order[start:end][np.argsort(own[:, dim], kind="stable")]
            middle = (start + end) // 2
            stack += [(middle, end, me), (start, middle, -1)]
    return order, np.array([tuple(x) for x in nodes], _NODE), np.array(centres), np.array(sums)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20:
        # products and sums stay below 2^53, so floating point is exact
        a, b = points.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (the first of ties) and the squared distance."""
    d = squared(points, centroids)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def assign(nodes: np.ndarray, centres: np.ndarray, points: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
    """Go down a tree (points in its order): (node, start, end, centroid) of balls that go whole, or an array of centroids, one
    for each vector of a leaf.

    Distances to the centre are rounded, so a centroid is only left out if it loses by more than the rounding could be.
    """
    away = np.sqrt(((centres[:, None] - centroids[None]) ** 2).sum(2))
    slack = 1e-6 * (1 + away.max(initial=0))
    stack: list[tuple[int, np.ndarray]] = [(0, np.arange(len(centroids)))]
    while stack:
        k, asked = stack.pop()
        start, end, right, radius = nodes[k]
        d = away[k, asked]
        # a centroid stays in question while some vector of the ball could be as near to it as to the best one
        asked = asked[d - radius <= d.min() + radius + slack]
        if len(asked) == 1:
            yield k, int(start), int(end), int(asked[0])
        elif right:
            stack += [(int(right), asked), (k + 1, asked)]
        else:
            yield k, int(start), int(end), asked[nearest(points[start:end], centroids[asked])[0]]


def plant(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The trees of ``kept()`` vectors, a row for each: ids and points in the tree's order, its nodes, centres and sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                points = part.column("point").flatten().to_numpy().reshape(-1, dimensions)
                order, nodes, centres, sums = build(points)
                ids = part.column("vec_id").take(pa.array(order))
                lists = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids)
                blobs = [points[order].astype("<i4").tobytes(), nodes.tobytes(), centres.astype("<f8").tobytes(), sums.astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([lists, *(pa.array([b], pa.binary()) for b in blobs)], ["vec_ids", "points", "nodes", "centres", "sums"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "point").mapInArrow(rows, _TREES)


def _read(row: dict, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["nodes"], _NODE), *(np.frombuffer(row[c], t).reshape(-1, dimensions) for c, t in (("centres", "<f8"), ("points", "<i4"), ("sums", "<i8")))


def _totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the vectors of each centroid that has any: one row for each task and centroid is shuffled."""
    dimensions = centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                nodes, centres, points, sums = _read(row, dimensions)
                for k, start, end, own in assign(nodes, centres, points, centroids):
                    if isinstance(own, int):
                        n[own] += end - start
                        total[own] += sums[k]
                    else:
                        n += np.bincount(own, minlength=len(n))
                        np.add.at(total, own, points[start:end])
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(total[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.select("points", "nodes", "centres", "sums").mapInArrow(rows, "cluster int, n bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(dimensions)]
    return {r.cluster: (r.n, [r[f"d{d}"] for d in range(dimensions)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()}


def first_centroids(vectors: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The n vectors with the smallest SHA-256 of ``1:<vec_id>`` (a null id: of ``1:``), ties by components."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "point").orderBy("h", "point").limit(n).collect()
    return np.array([r.point for r in rows], np.int64).reshape(-1, len(rows[0].point) if rows else DIMENSIONS)


def cluster(embeddings: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of every kept vector, and the final centroids.

    Rows with another number of components, or one that is null or not finite, are left out, as is a null vector; repeated rows
    stay repeated. With fewer than n vectors there are as many centroids; an empty table gives an empty result. Components
    beyond 2^24 saturate. A null vec_id stays null. Other columns are not read.
    """
    vectors = kept(embeddings, dimensions)
    centroids = first_centroids(vectors, n)
    trees = written(plant(vectors, dimensions), "trees")
    for _ in range(rounds):
        for c, (count, total) in _totals(trees, centroids).items():
            centroids[c] = [x // count for x in total]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                nodes, centres, points, _ = _read(one.select(["points", "nodes", "centres", "sums"]).to_pylist()[0], dimensions)
                best = np.zeros(len(points), np.int32)
                for _, start, end, own in assign(nodes, centres, points, centroids):
                    best[start:end] = own
                far = ((points.astype(np.int64) - centroids[best]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([one.column("vec_ids").flatten(), pa.array(best), pa.array(far)], ["vec_id", "cluster", "distance"])

    return written(trees.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids


def with_inertia(clustered: DataFrame) -> DataFrame:
    """``cluster_inertia`` and ``inertia``: distances summed over the cluster (a row for each on the driver) and over all; they
    saturate at the largest long."""
    most = (1 << 63) - 1
    by = {r.cluster: int(r.s) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = F.lit(None).cast("bigint")
    for c, s in by.items():
        own = F.when(F.col("cluster") == c, F.lit(min(s, most))).otherwise(own)
    return clustered.withColumns({"cluster_inertia": own.cast("bigint"), "inertia": F.lit(min(sum(by.values()), most)).cast("bigint")})


def by_centroid(centroids: np.ndarray, value) -> Column:
    """A value made of each centroid's components, by ``cluster``."""
    out = F.lit(None).cast("string")
    for c, own in enumerate(centroids.tolist()):
        out = F.when(F.col("cluster") == c, F.lit(value(own))).otherwise(out)
    return out
