"""Vector codes: vectors are cut into parts and each part is replaced by the number of its nearest codebook entry, in exact integers.

Components become integers (floor of ``scale`` times the component). Each part position has a codebook of ``entries`` parts, which starts with
those of the smallest keys and moves in ``rounds`` rounds to the floored means of the parts assigned to each entry.

The nearest entry is searched by LAESA pivots: the distances of every part to ``PIVOTS`` fixed pivots, the first entries of the first
codebook, are computed once and written beside the integers. In a round the distances between pivots and entries are computed, and by
the triangle inequality the largest difference of the two is a lower bound of the distance of part and entry. The
entries of a part are tried in order of this bound, and the search ends when the bound exceeds the smallest distance found; the others are
measured exactly in 64-bit integers. Stored distances are single precision: a margin above their rounding is taken off each
bound, so that the result is that of a full search, ties going to the lower index.

A round is one pass over the written rows that shuffles nothing but a row of sums per task, part and entry; only codebooks reach the
driver, and only codebooks and pivots go to the tasks.

Vectors that are null or empty, or that hold null or non-finite components take no part and have no row in the result. All others must
have one width, which the number of parts divides; else the call raises ``ValueError``. Repeated rows count as often as they occur;
rows with one key start in the order of their components, null keys start last. With fewer vectors than ``entries`` the codebooks are
shorter; empty tables give an empty result. Null labels are one label. Components that are too large for exact sums stop the job
(``integers.largest``).
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
from playlytics.operators.joins import null_safe_join

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 8, 16, 6, 4096, 4
_ROUNDED = 2.0**-22  # relative error of a stored distance, with room


def roots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The distance of each row to each of the few ``others``, in single precision."""
    found = np.empty((len(rows), len(others)), np.float32)
    for i, other in enumerate(others):
        away = rows - other
        found[:, i] = np.sqrt(np.einsum("ij,ij->i", away, away).astype(np.float64))
    return found


class Codebook:
    """The entries of one part position with their distances to the pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.to_pivots = entries, roots(entries, pivots).astype(np.float64)
        self.measured = 0  # distances computed so far

    def nearest(self, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row, the lowest of equals, and the squared distance."""
        bound = np.zeros((len(rows), len(self.entries)))
        for p in range(to_pivots.shape[1]):
            own, entry = to_pivots[:, p].astype(np.float64)[:, None], self.to_pivots[:, p][None, :]
            np.maximum(bound, np.abs(own - entry) - _ROUNDED * (own + entry), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        least = np.take_along_axis(bound, order, axis=1) ** 2
        best = np.full(len(rows), np.iinfo(np.int64).max, np.int64)
        which = np.full(len(rows), len(self.entries), np.int64)
        open_ = np.arange(len(rows))
        for turn in range(len(self.entries)):
            open_ = open_[least[open_, turn] <= best[open_].astype(np.float64) * (1 + integers.SLACK)]
            if not len(open_):
                break
            entry = order[open_, turn]
            away = rows[open_] - self.entries[entry]
            distance = np.einsum("ij,ij->i", away, away)
            self.measured += len(open_)
            better = (distance < best[open_]) | ((distance == best[open_]) & (entry < which[open_]))
            best[open_[better]], which[open_[better]] = distance[better], entry[better]
        return which, best


def _search(columns: list[pa.Array], codebooks: np.ndarray, searches: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: its number, the parts, and the indexes and squared distances of their entries."""
    vectors, pivots = columns
    parts, _, width = codebooks.shape
    rows = integers.matrix(vectors, len(vectors))
    stored = pivots.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), parts, -1)
    for p, search in enumerate(searches):
        own = rows[:, p * width : (p + 1) * width]
        yield p, own, *search.nearest(own, stored[:, p])


def width_of(vectors: DataFrame, vector: str, parts: int) -> int:
    """The one width of the vectors that take part, 0 if there is none."""
    least, most = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components in column {vector}")
    if (least or 0) % parts:
        raise ValueError(f"vectors of {least} components cannot be cut into {parts} equal parts")
    return least or 0


def _with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (key, label, v) with ``to_pivots``: part after part the distances to its pivots."""
    parts, _, width = pivots.shape
    kind = rows.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = integers.matrix(batch.column(2), batch.num_rows)
                found = [roots(v[:, p * width : (p + 1) * width], pivots[p]) for p in range(parts)]
                away = integers.lists(np.concatenate(found, axis=1), pa.float32())
                yield pa.RecordBatch.from_arrays([*batch.columns, away], names=["key", "label", "v", "to_pivots"])

    types = {f.name: f.dataType.simpleString() for f in kind}
    return rows.mapInArrow(run, f"key {types['key']}, label {types['label']}, v array<int>, to_pivots array<float>")


def _sums(rows: DataFrame, codebooks: np.ndarray, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Codebook(*both) for both in zip(codebooks, pivots, strict=True)]
        means = [integers.Means(*codebooks.shape[1:]) for _ in codebooks]
        for batch in batches:
            if batch.num_rows:
                for p, own, which, _ in _search(batch.columns, codebooks, searches):
                    means[p].add(own, which)
        for p, found in enumerate(means):
            yield from found.batches(p)

    return rows.select("v", "to_pivots").mapInArrow(run, integers.MEANS)


def _coded(rows: DataFrame, codebooks: np.ndarray, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Codebook(*both) for both in zip(codebooks, pivots, strict=True)]
        for batch in batches:
            if batch.num_rows:
                codes, error = np.zeros((batch.num_rows, len(codebooks)), np.int64), np.zeros(batch.num_rows, np.int64)
                for p, _, which, distance in _search(batch.columns[2:], codebooks, searches):
                    codes[:, p] = which
                    error += distance
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), integers.lists(codes, pa.int32()), pa.array(error)],
                    names=["key", "label", "codes", "error"],
                )

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"key {types['key']}, label {types['label']}, codes array<int>, error bigint")


def fit(
    vectors: DataFrame, key: str, vector: str, label: str, parts: int, entries: int, rounds: int, scale: int, pivots: int
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written rows (key, label, v, to_pivots), the codebooks (part, entry, component) and the pivots."""
    some = vectors.where((F.size(vector) > 0) & integers.is_finite(vector))
    width = width_of(some, vector, parts)
    rows = some.select(F.col(key).alias("key"), F.col(label).alias("label"), integers.floors(vector, scale, integers.largest(width)).alias("v"))
    first = integers.first_rows(rows, [F.col("key").asc_nulls_last(), F.col("v").asc()], entries, width)
    codebooks = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    fixed = codebooks[:, :pivots].copy()
    rows = materialise(_with_pivots(rows, fixed), "parts")
    for _ in range(rounds if len(first) else 0):
        codebooks = integers.moved(_sums(rows, codebooks, fixed), codebooks)
    return rows, codebooks, fixed


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """(key, codes, error, label_error) of each vector that takes part, and the codebooks (part, entry, component)."""
    rows, codebooks, fixed = fit(vectors, key, vector, label, parts, entries, rounds, scale, pivots)
    coded = materialise(_coded(rows, codebooks, fixed), "codes")
    # written, so that its true size decides how it is joined
    by_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = null_safe_join(coded, by_label, ["label"])
    return joined.select(F.col("key").alias(key), "codes", "error", "label_error"), codebooks


def hex_code(codes: str = "codes", digits: int = 2):
    """The indexes in part order, two hex digits each, which is enough for 256 entries."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(integers.digest(codebooks)).hexdigest()
