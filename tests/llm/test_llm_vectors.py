"""Clustering against a plain model in Python's numbers, the pivot bound, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from relaygauge.llm.centroids import cluster_vectors, nearest, squared


def model(rows, clusters=8, rounds=10, seed=3, dimensions=64):
    kept = [
        (key, [math.floor(1024 * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in ordered[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, i) in zip(kept, found) if i == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    inertia = [sum(d for d, i in found if i == c) for c in range(len(centroids))]
    return sorted(
        ((0 if key is None else key), i, d, inertia[i], sum(inertia), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest())
        for (key, _), (d, i) in zip(kept, found)
    )


def rows_of(frame):
    return sorted((r[0] or 0, *r[1:]) for r in map(tuple, frame.collect()))


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def as_float(rows):
    """Components as the table holds them, in 32 bits."""
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]


def test_equal_to_the_model(spark):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(12, 64))
    rows = as_float([(i, (middles[i % 12] + 0.3 * draw.normal(size=64)).tolist()) for i in range(400)])
    found = cluster_vectors(frame_of(spark, rows).repartition(5))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(found) == model(rows)


def test_other_parameters_and_ties(spark):
    # Whole numbers on a line give many equal distances.
    rows = as_float([(i, [float(i % 10) / 64, 0.0, 0.0]) for i in range(60)])
    found = cluster_vectors(frame_of(spark, rows), clusters=4, rounds=3, seed=9, dimensions=3, pivots=2)
    assert rows_of(found) == model(rows, 4, 3, 9, 3)


def test_odd_rows(spark):
    draw = np.random.default_rng(7)
    good = draw.normal(size=(5, 64)).tolist()
    rows = [
        (None, good[0]),
        (1, None),
        (2, []),
        (3, good[1][:63]),
        (4, [*good[1][:63], None]),
        (5, [*good[1][:63], float("nan")]),
        (6, [*good[1][:63], float("-inf")]),
        (7, good[2]),
        (7, good[2]),
        (7, good[2]),
        (8, [0.0] * 64),
        (9, [-0.0] * 64),
        (10, good[3]),
        (11, [-1e-7] * 64),
    ]
    rows = as_float(rows)
    frame = frame_of(spark, rows).selectExpr("*", "0 AS cluster", "0 AS distance", "0 AS _key", "0 AS _x")
    assert rows_of(cluster_vectors(frame)) == model(rows)
    assert rows_of(cluster_vectors(frame.where("vec_id = 7"))) == model([r for r in rows if r[0] == 7])
    assert cluster_vectors(frame.limit(0)).collect() == []
    assert cluster_vectors(frame.where("vec_id < 7")).collect() == []


def test_huge_components_are_held_within_bounds(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)]
    found = {r.vec_id: r for r in cluster_vectors(frame_of(spark, rows)).collect()}
    assert sorted(found) == [1, 2, 3] and all(r.distance == 0 for r in found.values())


@pytest.mark.parametrize("seed", range(3))
def test_the_bound_rules_out_and_loses_nothing(seed):
    draw = np.random.default_rng(seed)
    middles = draw.integers(-4000, 4000, (9, 64))
    vectors = (middles[draw.integers(0, 9, 3000)] + draw.integers(-200, 200, (3000, 64))).astype(np.int32)
    centroids, pivots = middles[:8].astype(np.int32), vectors[:6]
    far = np.stack([np.sqrt(squared(vectors, p).astype(float)) for p in pivots], axis=1)
    best, least, computed = nearest(vectors, far, centroids, pivots)
    exact = np.stack([squared(vectors, c) for c in centroids], axis=1)
    assert (best == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert computed < 0.6 * exact.size
