"""Vectors of integers for the exact operators: floors of scaled components, as Spark arrays and as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9  # share by which a bound computed in floating point must pass an exact distance before it rejects
FAR = (1 << 31) + 1  # above any difference of two component sums


def largest(width: int, factor: int = 1) -> int:
    """A bound of components with which ``factor`` times a sum of ``width`` squared differences stays in 64 bits."""
    return isqrt((1 << 60) // max(1, width * factor))


def is_finite(vector: str) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, ok), F.lit(False))


def floors(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, in double precision; one that is not below ``limit`` stops the job."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * scale
        too_large = F.raise_error(F.lit(f"a component of {vector} times {scale} is not below {limit}")).cast("int")
        return F.when(F.abs(scaled) < limit, F.floor(scaled).cast("int")).otherwise(too_large)

    return F.transform(vector, one)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """The vectors of an Arrow column (no nulls, one width) as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(rows, -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    n, width = rows.shape
    offsets = pa.array(np.arange(0, n * width + 1, width) if width else np.zeros(n + 1, int), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), kind))


class Means:
    """Sums and counts of vectors by entry, kept while a task reads its batches."""

    def __init__(self, entries: int, width: int):
        self.sums, self.counts = np.zeros((entries, width), np.int64), np.zeros(entries, np.int64)

    def add(self, rows: np.ndarray, entry: np.ndarray) -> None:
        for e in np.flatnonzero(np.bincount(entry, minlength=len(self.counts))):
            own = rows[entry == e]
            self.sums[e] += own.sum(axis=0)
            self.counts[e] += len(own)

    def batches(self, part: int = 0) -> Iterator[pa.RecordBatch]:
        """One row per entry in use: a task returns sums, never vectors."""
        used = np.flatnonzero(self.counts)
        if len(used):
            columns = [pa.array(np.full(len(used), part), pa.int32()), pa.array(used, pa.int32()), pa.array(self.counts[used])]
            yield pa.RecordBatch.from_arrays([*columns, lists(self.sums[used], pa.int64())], names=["part", "entry", "n", "sums"])


MEANS = "part int, entry int, n bigint, sums array<bigint>"


def moved(found: DataFrame, entries: np.ndarray) -> np.ndarray:
    """``entries`` (part, entry, component) with each used one at the floored mean of its vectors, from rows of ``MEANS``.

    The sums of the tasks are added per component as decimals, so they are exact; a row per entry reaches the driver.
    """
    width = entries.shape[2]
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = entries.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def digest(entries: np.ndarray) -> bytes:
    """All components as decimal integers, joined by commas."""
    return ",".join(map(str, entries.reshape(-1).tolist())).encode()


def first_rows(rows: DataFrame, order: list[Column], n: int, width: int) -> np.ndarray:
    """The vectors ``v`` of the first ``n`` rows in ``order``; equal rows may stand for each other."""
    found = [r["v"] for r in rows.orderBy(*order).limit(n).select("v").collect()]
    return np.array(found, np.int64).reshape(len(found), width)
