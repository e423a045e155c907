"""Clustering with ball trees against plain rounds over all vectors."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from phonolith.llm import ball_trees, queries


def plain(rows, n=16, rounds=3, dimensions=64):
    """(vec_id, cluster, distance) of each kept row, and the centroids, one by one."""
    vectors = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(64 * x) for x in v]))
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v, v) for i, v in vectors)[:n]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in vectors:
            own[best(v)[1]].append(v)
        for k, vs in own.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return [(i, best(v)[1], best(v)[0]) for i, v in vectors], centroids


def test_all_rows_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op13_centroid_clustering(spark, "/root/testdata/sf0.001").collect()
    want, centroids = plain(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    inertia = defaultdict(int)
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for k in range(300)]
    rows += [(1000 + k, [0.5, 0.5, -0.5, 0.25]) for k in range(400)] + rows[:30]
    odd = [(None, [0.0] * 4), (5000, None), (5001, []), (5002, [0.1] * 3), (5003, [0.1, None, 0.2, 0.3]), (5004, [math.nan] * 4), (5005, [math.inf, 0.0, 0.0, 0.0]), (5006, [-0.001, 0.999, -1.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id bigint, embedding array<double>, cluster string").repartition(3)
    clustered, centroids = ball_trees.cluster(df, n=5, dimensions=4)
    want, plain_centroids = plain(rows + odd, n=5, dimensions=4)
    assert sorted(map(repr, map(tuple, clustered.collect()))) == sorted(map(repr, want)) and centroids.tolist() == plain_centroids


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(1, [0.25] * 64), (2, [0.5] * 64)], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in ball_trees.with_inertia(ball_trees.cluster(df)[0]).drop("cluster").collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert ball_trees.with_inertia(ball_trees.cluster(df.limit(0))[0]).collect() == []


def test_huge_components_saturate(spark):
    df = spark.createDataFrame([(k, [1e300 if k % 2 else -1e300] * 64) for k in range(6)], "vec_id bigint, embedding array<double>")
    got = ball_trees.with_inertia(ball_trees.cluster(df, n=1)[0]).collect()
    assert {r.distance for r in got} == {64 * ball_trees.MOST**2}


@pytest.mark.parametrize("spread", [0.5, 20, 1 << 22])
def test_trees_find_the_nearest_of_all_centroids(spread):
    rng = np.random.default_rng(6)
    points = (rng.normal(0, spread, (3000, 8)) + 10 * spread * rng.integers(0, 4, (3000, 1))).astype(np.int64)
    points[500:900] = points[0]
    centroids = points[rng.integers(0, 3000, 7)]
    order, nodes, centres, sums = ball_trees.build(points)
    own, whole = np.full(len(points), -1), 0
    for k, start, end, best in ball_trees.assign(nodes, centres, points[order], centroids):
        assert (own[start:end] == -1).all()
        own[start:end] = best
        if isinstance(best, int):
            whole += end - start
            assert sums[k].tolist() == points[order[start:end]].sum(0).tolist()
    far = ((points[order][:, None] - centroids) ** 2).sum(2)
    assert own.tolist() == far.argmin(1).tolist() and whole > 0
