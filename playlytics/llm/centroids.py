"""Centroid clustering by equal-average equal-variance search, in exact integers.

``cluster`` turns the components of each vector into integers (floor of ``scale`` times the component) and moves ``n`` centroids in
``rounds`` rounds to the floored means of their vectors. The first centroids are the vectors with the smallest
SHA-256 of ``<salt><key>``.

A vector's nearest centroid is searched outward from its own mean: the centroids lie in order of their component mean, and the
nearer one of the two next in line comes first. Of two vectors of d components with sums s, t and root deviations V, W
(V^2 = the sum of squared differences from the mean) the squared distance is at least (s-t)^2 / d + (V-W)^2. The search ends when the
first term alone exceeds the smallest distance yet, and passes by a centroid when both terms do; all others are measured exactly
in 64-bit integers. Bounds in floating point must pass the distance by a margin far above their rounding, so that the
result is that of a full search, ties going to the smaller number.

A round is one pass over the written integers that shuffles nothing but one row of sums per task and centroid; only centroids reach the
driver. Of a broadcast, only ``n`` centroids go to the tasks.

Vectors that are null, of another width than ``width``, or that hold null or non-finite components take no part and have no row in
the result. Repeated rows count as often as they occur; rows with one key start in the order of their components; null keys start
last, and keep their row. With fewer vectors than ``n`` there are as many centroids; empty tables give an empty result. Components
that are too large for exact sums stop the job (``integers.largest``: 2^24 after scaling at width 64).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.llm import integers
from playlytics.llm.common import materialise

CLUSTERS, ROUNDS, SCALE, WIDTH, SALT = 16, 3, 64, 64, "1:"


def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component sum of each row, and the root of its squared deviation from the mean times the width."""
    total = rows.sum(axis=1)
    return total, np.sqrt((rows.shape[1] * np.einsum("ij,ij->i", rows, rows) - total * total).astype(np.float64))


class MeanOrder:
    """Centroids in order of their mean."""

    def __init__(self, centroids: np.ndarray):
        total, deviation = moments(centroids)
        self.number = np.argsort(total, kind="stable")
        self.rows, self.total, self.deviation = centroids[self.number], total[self.number], deviation[self.number]
        self.measured = 0  # distances computed so far

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row, the smallest of equals, and the squared distance."""
        n, width, k = len(rows), rows.shape[1], len(self.rows)
        total, deviation = moments(rows)
        best = np.full(n, np.iinfo(np.int64).max // max(1, width), np.int64)
        which = np.full(n, k, np.int64)
        above = np.searchsorted(self.total, total)
        below = above - 1
        open_ = np.arange(n)
        while len(open_):
            low, high, own = below[open_], above[open_], total[open_]
            down = np.where(low >= 0, own - self.total[low], integers.FAR)
            up = np.where(high < k, self.total[np.minimum(high, k - 1)] - own, integers.FAR)
            gap = np.minimum(down, up)
            # the next centroid has the smallest gap of all that are left, so the search of the others has ended
            go_on = (gap < integers.FAR) & (gap * gap <= width * best[open_])
            open_, gap = open_[go_on], gap[go_on]
            is_down = (down <= up)[go_on]
            place = np.where(is_down, low[go_on], high[go_on])
            below[open_[is_down]] -= 1
            above[open_[~is_down]] += 1
            apart = np.abs(deviation[open_] - self.deviation[place])
            apart = np.maximum(0.0, apart - integers.SLACK * (1 + apart))
            kept = gap.astype(np.float64) ** 2 + apart**2 <= width * best[open_].astype(np.float64) * (1 + integers.SLACK)
            at, place = open_[kept], place[kept]
            away = rows[at] - self.rows[place]
            distance = np.einsum("ij,ij->i", away, away)
            self.measured += len(at)
            number = self.number[place]
            better = (distance < best[at]) | ((distance == best[at]) & (number < which[at]))
            best[at[better]], which[at[better]] = distance[better], number[better]
        return which, best


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(key, v) of the vectors that take part, written."""
    some = vectors.where((F.size(vector) == width) & integers.is_finite(vector))
    return materialise(some.select(F.col(key).alias("key"), integers.floors(vector, scale, integers.largest(width, width)).alias("v")), "integers")


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, means = MeanOrder(centroids), integers.Means(*centroids.shape)
        for batch in batches:
            if batch.num_rows:
                found = integers.matrix(batch.column(0), batch.num_rows)
                means.add(found, search.nearest(found)[0])
        yield from means.batches()

    return rows.select("v").mapInArrow(run, integers.MEANS)


def fit(rows: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, salt: str = SALT) -> np.ndarray:
    """The centroids after ``rounds`` rounds over written rows (key, v)."""
    place = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    centroids = integers.first_rows(rows, [place.asc_nulls_last(), F.col("v").asc()], n, width)
    for _ in range(rounds if len(centroids) else 0):
        centroids = integers.moved(_sums(rows, centroids), centroids[None])[0]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of each row (key, v)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = MeanOrder(centroids)
        for batch in batches:
            if batch.num_rows:
                which, distance = search.nearest(integers.matrix(batch.column(1), batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(which, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"]
                )

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, cluster int, distance bigint")


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    n: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    width: int = WIDTH,
    salt: str = SALT,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of each vector that takes part."""
    rows = integer_vectors(vectors, key, vector, scale, width)
    centroids = fit(rows, n, rounds, width, salt)
    assigned = materialise(assign(rows, centroids), "assigned")
    # from here on a row per centroid
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    listed = [(i, inertia[i], sum(inertia.values()), c.tolist(), _sha256(c)) for i, c in enumerate(centroids) if i in inertia]
    schema = "number int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string"
    table = vectors.sparkSession.createDataFrame(listed, schema)
    joined = assigned.join(F.broadcast(table), assigned["cluster"] == table["number"])
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def _sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(integers.digest(centroid)).hexdigest()
