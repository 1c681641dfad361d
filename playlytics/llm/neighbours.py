"""Approximate nearest neighbours by cross-polytope hashing, with exact distances.

A pseudo-random rotation is three rounds of random signs and a fast Hadamard transform. The hash of a unit vector is the
signed axis nearest to its rotation; ``TABLES`` tables hash by ``HASHES`` rotations each. A query looks into its own bucket and into those of
the next nearest axes (``PROBES`` per table). Its candidates are compared by the exact Euclidean distance of the
original vectors, in double precision. The hash is the same for tables of any size: a further rotation squares the number of buckets,
and with the same tables and probes most of the neighbours would be missed.

Vectors are dealt by (table, bucket). A large bucket is cut into blocks of at most about ``BLOCK`` vectors by a hash, and its queries
go to every block, so that a bucket of any size is searched whole without meeting in one task. A task
returns the best k of each query per block only. A query that finds fewer than k candidates in its buckets is compared
with all vectors, in blocks as well.

Vectors that are null, empty or zero, or that hold null or non-finite components take no part; only vectors of equal length are
compared. Rows equal in id and vector count once; of different rows with one id each is a query of its own, and a candidate of the others. A
null id is never a query; it ranks last among ties. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlytics.llm.common import materialise, sorted_groups

TABLES = 16
PROBES = 10
HASHES = 1  # rotations in a hash; tables and probes are chosen for it
BLOCK = 4096
QUERY_BLOCK = 512
SEED = 20


@lru_cache
def signs(size: int, tables: int, hashes: int) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    return draw.choice(np.array([-1.0, 1.0]), size=(tables, hashes, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for flip in flips:
        x = hadamard(x * flip)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    out[:, : x.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return out


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """The best ``probes`` buckets of each vector in each table, best first; unused places hold -1."""
    unit = _unit(x)
    axes = 2 * unit.shape[1]
    flips = signs(unit.shape[1], tables, hashes)
    out = np.full((len(x), tables, probes), -1, np.int64)
    for t in range(tables):
        bucket, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for h in range(hashes):
            turned = rotate(unit, flips[t, h])
            both = np.concatenate([turned, -turned], axis=1)
            near = np.argsort(-both, axis=1, kind="stable")[:, : min(probes, axes)]
            gap = 1 - np.take_along_axis(both, near, axis=1)
            bucket = (bucket[:, :, None] * axes + near[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            bucket, loss = np.take_along_axis(bucket, order, axis=1), np.take_along_axis(loss, order, axis=1)
        out[:, t, : bucket.shape[1]] = bucket
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, width) of the vectors that take part, in double precision."""
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).alias("id"), value.alias("v"))
    rows = rows.where("v is not null").where(F.forall("v", finite)).where(F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates().withColumn("width", F.size("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _bucketed(rows: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """Each row once for each of its buckets."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["row", "id", "v", "width"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width in set(batch.column("width").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("width"), width))
                found = codes(_matrix(part.column("v"), width), tables, hashes, probes)
                for t in range(tables):
                    for p in range(probes):
                        some = np.flatnonzero(found[:, t, p] >= 0)
                        if len(some):
                            own = part.take(pa.array(some))
                            more = [pa.array(np.full(len(some), t, np.int32)), pa.array(found[some, t, p])]
                            yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*names, "tab", "bucket"])

    return rows.select(names).mapInArrow(run, f"row bigint, id {kind}, v array<double>, width int, tab int, bucket bigint")


def _meet(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, row, id, score): in each block of each bucket the best ``k`` candidates of each query."""
    place = ["width", "tab", "bucket"]
    asked = queries.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks"))
    held = candidates.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    extent = materialise(held.join(asked, place), "buckets")  # one small row per bucket
    own = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    fields = [*place, "block", "query_block", "asks", "row", "id", "v"]
    left = candidates.join(extent, place).withColumns({"asks": F.lit(False), "block": own("blocks", 1)})
    left = left.withColumn("query_block", every("query_blocks")).select(fields)
    right = queries.join(extent, place).withColumns({"asks": F.lit(True), "query_block": own("query_blocks", 2)})
    right = right.withColumn("block", every("blocks")).select(fields)
    keys = (*place, "block", "query_block")
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "asks")
    kind = candidates.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(lambda b: sorted_groups(b, keys, None, lambda t: _nearest(t, keys, k)), f"query_row bigint, query_id {kind}, row bigint, id {kind}, score double")


def _nearest(table: pa.Table, keys: tuple[str, ...], k: int) -> Iterator[pa.RecordBatch]:
    change = np.zeros(table.num_rows + 1, bool)
    change[0] = change[-1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    cuts = np.flatnonzero(change)
    asks, widths = table.column("asks").to_numpy(), table.column("width").to_numpy()
    ids, row_numbers = table.column("id").combine_chunks(), table.column("row").to_numpy()
    query_rows, rows, scores = [], [], []
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        middle = first + int(np.argmax(asks[first:end])) if asks[end - 1] else end
        if middle in (first, end):
            continue
        vectors = _matrix(table.column("v").slice(first, end - first), widths[first])
        names = ids.slice(first, end - first)
        known, own = names.to_pylist(), row_numbers[first:end]
        candidates, numbers = vectors[: middle - first], np.arange(middle - first)
        for q in range(middle - first, end - first):
            score = np.sqrt(((candidates - vectors[q]) ** 2).sum(axis=1))
            few = min(k + 1, len(score))  # its own row may be among them
            limit = np.partition(score, few - 1)[few - 1]  # ties at the limit all stay
            near = numbers[score <= limit]
            near = sorted((score[c], known[c] is None, known[c], c) for c in near if own[c] != own[q])[:k]
            for s, _, _, c in near:
                query_rows.append(first + q)
                rows.append(first + c)
                scores.append(float(s))
    out = []
    for taken in (query_rows, rows):
        out += [pa.array(row_numbers[np.array(taken, np.int64)]), ids.take(pa.array(taken, pa.int64()))]
    yield pa.RecordBatch.from_arrays([*out, pa.array(scores, pa.float64())], names=["query_row", "query_id", "row", "id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query; of the rows that several tables return one counts."""
    order = Window.partitionBy("query_row").orderBy("score", F.col("id").asc_nulls_last(), "row")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest vectors found for each row where ``is_query`` holds for its ``id``."""
    # rows are numbered by writing them: several may have one id
    rows = materialise(usable(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("id").isNotNull() & is_query)
    fields = ["query_row", "query_id", "rank", "id", "score"]
    found = _best(_meet(_bucketed(rows, tables, HASHES, 1), _bucketed(asked, tables, HASHES, probes), k), k)
    found = materialise(found.select(fields), "neighbours")
    number = found.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("found"))
    short = asked.join(number, "row", "left").where(F.coalesce("found", F.lit(0)) < k).select("row", "id", "v", "width")
    short = materialise(short, "short")
    if short.isEmpty():
        return found.drop("query_row")
    whole = lambda df: df.withColumns({"tab": F.lit(0), "bucket": F.lit(0).cast("bigint")})
    exact = _best(_meet(whole(rows), whole(short), k), k).select(fields)
    kept = found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti")
    return kept.select(fields).unionByName(exact).drop("query_row")
