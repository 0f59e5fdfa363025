"""Centroid clustering in whole numbers, with a table of distances to fixed pivots.

The distances of each vector to a few pivots are stored once, beside the vector.  In each round the
centroids' distances to the same pivots give a lower bound of every distance between a vector and a
centroid, and only centroids that the bound does not rule out get an exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaygauge.llm.frames import byte_arrays, finished, stage

# Components are held within +-LARGEST after scaling, so a squared distance fits 64 bits.
LARGEST = 1 << 27
SCALE = 1024
# Vectors of a stored table that a Python worker compares at once.
ROWS = 8192
# Relative slack of the bound, far above the rounding of its square roots.
SLACK = 1e-9


def whole_vectors(table: DataFrame, dimensions: int, vector: str, key: str) -> DataFrame:
    """(_key, _vec) of the rows that have ``dimensions`` finite components: floor(1024 * x) as 32-bit numbers."""
    kept = table.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_x")).where(
        F.col("_x").isNotNull() & (F.size("_x") == dimensions)
    )
    finite = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(
        "_x", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    )
    return kept.where(finite).select("_key", scaled.alias("_vec"))


def _matrix(column: pa.Array, dimensions: int, kind: type) -> np.ndarray:
    data, _ = byte_arrays(column)
    return data.view(kind).reshape(-1, dimensions) if len(data) else np.zeros((0, dimensions), kind)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    flat = np.ascontiguousarray(rows).tobytes()
    return pa.array([flat[i : i + width] for i in range(0, len(flat), width)], pa.binary())


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of 32-bit vectors to one point."""
    apart = vectors.astype(np.int64) - point.astype(np.int64)
    return np.einsum("ij,ij->i", apart, apart)


def _pivot_table(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dimensions = pivots.shape[1]

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                flat = part.column("_vec").flatten().to_numpy(zero_copy_only=False)
                vectors = flat.astype(np.int32).reshape(-1, dimensions)
                far = np.stack([np.sqrt(squared(vectors, p).astype(np.float64)) for p in pivots], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), _binary(vectors), _binary(far)], ["_key", "_vec", "_far"]
                )

    return table


def nearest(vectors: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the smaller number of equals, its squared distance, and how
    many distances to centroids were computed.

    ``far`` holds the vectors' distances to the pivots.  |d(v, p) - d(c, p)| is at most d(v, c) for each
    pivot p, so a centroid whose bound is above the least distance found so far is passed over.
    """
    n, k = len(vectors), len(centroids)
    reach = np.stack([np.sqrt(squared(centroids, p).astype(np.float64)) for p in pivots], axis=1)
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(far[:, p, None] - reach[None, :, p]) - SLACK * (far[:, p, None] + reach[None, :, p]), out=bound)
    bound = bound * bound * (1 - SLACK)
    first = np.argmin(bound, axis=1)
    least = np.empty(n, np.int64)
    for c in range(k):
        at = np.flatnonzero(first == c)
        least[at] = squared(vectors[at], centroids[c])
    best, computed = first.astype(np.int64), n
    for c in range(k):
        at = np.flatnonzero((first != c) & (bound[:, c] <= least))
        computed += len(at)
        exact = squared(vectors[at], centroids[c])
        nearer = (exact < least[at]) | ((exact == least[at]) & (c < best[at]))
        least[at[nearer]] = exact[nearer]
        best[at[nearer]] = c
    return best, least, computed


def _parts(table: pa.RecordBatch, dimensions: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for i in range(0, table.num_rows, ROWS):
        part = table.slice(i, ROWS)
        yield part, _matrix(part.column("_vec"), dimensions, np.int32), _matrix(part.column("_far"), pivots, np.float64)


def _sums(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per task and centroid: how many vectors are nearest to it, and the sum of each component."""
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, vectors, far in _parts(batch, dimensions, len(pivots)):
                best, _, _ = nearest(vectors, far, centroids, pivots)
                counts += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    sums[c] += vectors[best == c].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    return add


def _assigned(centroids: np.ndarray, pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors, far in _parts(batch, centroids.shape[1], len(pivots)):
                best, least, _ = nearest(vectors, far, centroids, pivots)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array(best, pa.int32()), pa.array(least)], ["_key", "cluster", "distance"]
                )

    return assign


def seeded_order(key: str, seed: int) -> Column:
    """sha256 of ``seed:key`` with the key in decimal; a null key counts as empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)


def moved(centroids: Sequence[Sequence[int]], sums: dict[int, tuple[int, Sequence[int]]]) -> list[list[int]]:
    """Centroids after a round: the floor of the mean of their vectors; those without vectors stay."""
    return [
        [s // sums[c][0] for s in sums[c][1]] if c in sums else list(old) for c, old in enumerate(centroids)
    ]


def cluster_vectors(
    table: DataFrame,
    clusters: int = 8,
    rounds: int = 10,
    seed: int = 3,
    dimensions: int = 64,
    pivots: int = 6,
    vector: str = "embedding",
    key: str = "vec_id",
) -> DataFrame:
    """(``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector.

    Kept are vectors of just ``dimensions`` components, none null or non-finite; a component counts as
    floor(1024 * x), beyond +-2^27 as that.  Centroids start as the first vectors by the seeded hash of
    their key, then by components; fewer vectors give fewer centroids, and repeated rows may start several,
    of which the later ones stay empty.  Each round takes every vector to the nearest centroid (the smaller number of
    equals) and every centroid with vectors to the floor of their mean.  A null key is kept and hashed
    as empty text; an empty table gives no rows; other columns are not read.  Sums beyond 64 bits are given
    as the largest 64-bit number.

    Vectors and their distances to the pivots, which are the first centroids, are stored once.  A round
    reads that table and shuffles a row per task and centroid; the driver keeps the centroids only.
    """
    spark = table.sparkSession

    def work() -> DataFrame:
        vectors = whole_vectors(table, dimensions, vector, key)
        order = seeded_order("_key", seed)
        # The first rows of each task, then of all; nothing is sorted as a whole.
        start = [r["_vec"] for r in vectors.orderBy(order, "_vec").limit(max(clusters, pivots)).collect()]
        kind = vectors.schema["_key"].dataType.simpleString()
        out = f"_key {kind}, cluster int, distance long"
        if not start:
            return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
        fixed = np.array(start[:pivots], np.int32)
        centroids = [list(v) for v in start[:clusters]]
        stored = stage(vectors.mapInArrow(_pivot_table(fixed), f"_key {kind}, _vec binary, _far binary"), "pivot-distances")
        wide = F.posexplode("sums").alias("place", "part")
        for _ in range(rounds):
            step = stored.mapInArrow(_sums(np.array(centroids, np.int32), fixed), "cluster int, n long, sums array<long>")
            added = (
                step.select("cluster", "n", wide)
                .groupBy("cluster", "place")
                .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
                .collect()
            )
            sums: dict[int, tuple[int, list[int]]] = {}
            for r in added:
                sums.setdefault(r["cluster"], (r["n"], [0] * dimensions))[1][r["place"]] = int(r["total"])
            centroids = moved(centroids, sums)
        last = np.array(centroids, np.int32)
        assigned = stage(stored.mapInArrow(_assigned(last, fixed), out), "assigned")
        inertia = {
            r["cluster"]: int(r["total"])
            for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
        }
        most = (1 << 63) - 1
        prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
        # A row per centroid, as expressions.
        per = F.element_at(F.array(*[F.lit(min(inertia.get(c, 0), most)).cast("long") for c in range(len(centroids))]), F.col("cluster") + 1)
        names = F.element_at(F.array(*[F.lit(p) for p in prints]), F.col("cluster") + 1)
        return assigned.select(
            "_key",
            "cluster",
            "distance",
            per.alias("cluster_inertia"),
            F.lit(min(sum(inertia.values()), most)).cast("long").alias("inertia"),
            names.alias("centroid_sha256"),
        )

    result = finished(spark, "clusters", work)
    return result.withColumnRenamed("_key", key)
