"""A sparse graph of similar songs, without a table of all pairs, and communities in it.

``neighbour_graph`` hashes the unit vectors by random projections (``TABLES`` keys of ``PROJECTIONS`` buckets each), compares the songs that share
a key, and keeps each song's ``m`` most similar ones. A bucket of any size is searched whole: it is cut into blocks, every two blocks
of a bucket meet in a task of their own, and a task returns at most ``m`` rows per song, also of many equal ones. A song moves once per table and
block of its bucket, so blocks are large (``BLOCK`` songs, 32 MB at width 64) and are compared in ``TILE`` pieces. How much of the neighbours is found, and
how many pairs are compared for it, depends on the data: among clustered vectors the buckets hold the own cluster, among vectors in
all directions (as in the test tables) finding nine of ten neighbours takes most of all pairs.

``strongest`` keeps a share of the edges by a quantile of their weights, which a sketch estimates in one pass.

``communities`` cuts the graph by power iteration clustering. Songs without an edge belong to no community.

Songs without a direction (NULL, zero or missing components) have no neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.functions.vectors import normalise_rows
from playlytics.sources.storage import materialise

NEIGHBOURS = 10
TABLES, PROJECTIONS, LENGTH = 16, 3, 0.5
BLOCK = 64_000  # songs of a bucket that meet in a task
TILE = (512, 4_096)  # songs asking and held that are compared at a time
NOISE = 4e-13  # below half of the last digit to which weights are rounded
SKETCH_SIZE = 1_000
EDGE = "src bigint, dst bigint, weight double"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, embedding) of length 1; songs without a direction are left out."""
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    some = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    some = normalise_rows(some.where(usable & F.exists("embedding", lambda x: x != 0)))
    return some.where(F.forall("embedding", lambda x: x.isNotNull()))


def _keyed(units: DataFrame, tables: int, projections: int, length: float, seed: int) -> DataFrame:
    """Each song once per table, with its key in it."""
    features = units.withColumn("features", array_to_vector("embedding"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", numHashTables=tables * projections, bucketLength=length, seed=seed
    )
    hashed = lsh.fit(features).transform(features)
    numbers = F.transform("hashes", lambda h: vector_to_array(h)[0])
    keys = F.array(
        *[
            F.struct(F.lit(t).alias("tab"), F.xxhash64(F.slice("numbers", t * projections + 1, projections)).alias("key"))
            for t in range(tables)
        ]
    )
    return hashed.withColumn("numbers", numbers).select("id", "embedding", F.inline(keys))


def _in_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """Each song once for every two blocks of its bucket that hold it, with its own block."""
    place = ["tab", "key"]
    sizes = keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a song alone meets no other
    blocks = materialise(sizes.select(*place, F.ceil(F.col("n") / block).alias("blocks")), "buckets")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    dealt = keyed.join(blocks, place).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    met = dealt.withColumn("other", other)
    return met.select(
        *place, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "embedding"
    )


def _closest(table: pa.Table, m: int) -> pa.Table:
    """The ``m`` most similar songs of each song: of the other block, or of the one block that there is."""
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    rows = table.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    own = table.column("own").to_numpy()
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    sides = [np.flatnonzero(own == first), np.flatnonzero(own == second)]
    found = _best(ids, rows, sides[0], sides[1], m)
    if first != second:
        found += _best(ids, rows, sides[1], sides[0], m)
    src, dst, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "weight": pa.array(weight, pa.float64())})


def _best(ids: np.ndarray, rows: np.ndarray, asks: np.ndarray, held: np.ndarray, m: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of the asking songs: ids, the ids of the most similar ones, weights. Places are in order of ids."""
    out = [(ids[:0], ids[:0], np.zeros(0))]
    for at in range(0, len(asks), TILE[0]):
        some = asks[at : at + TILE[0]]
        a, b, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = np.full(len(some), -np.inf)  # the m-th best so far; a later song, of a larger id, must pass it
        for start in range(0, len(held), TILE[1]):
            other = held[start : start + TILE[1]]
            similar = rows[some] @ rows[other].T
            place = np.minimum(np.searchsorted(other, some), len(other) - 1)
            same = np.flatnonzero(other[place] == some)
            similar[same, place[same]] = -np.inf
            least = limit + NOISE
            if similar.shape[1] > m:
                unset = np.flatnonzero(limit == -np.inf)
                least[unset] = np.partition(similar[unset], -m, axis=1)[:, -m] - 2 * NOISE
            x, y = np.nonzero(similar > np.maximum(least, -2)[:, None])
            if not len(x):
                continue
            a, b = np.concatenate([a, x]), np.concatenate([b, other[y]])
            weight = np.concatenate([weight, np.round(similar[x, y], 12)])
            order = np.lexsort((b, -weight, a))
            a, b, weight = a[order], b[order], weight[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, weight, rank = a[rank < m], b[rank < m], weight[rank < m], rank[rank < m]
            limit[a[rank == m - 1]] = weight[rank == m - 1]
        out.append((ids[some][a], ids[b], weight))
    return out


def neighbour_graph(
    vectors: DataFrame,
    m: int = NEIGHBOURS,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    length: float = LENGTH,
    seed: int = DEFAULTS.seed,
    block: int = BLOCK,
) -> DataFrame:
    """(src, dst, weight): the ``m`` most similar songs found for each song, by cosine; ties to the smaller id. ``id`` is unique."""
    units = materialise(unit_vectors(vectors), "units")
    if units.isEmpty():
        return vectors.sparkSession.createDataFrame([], EDGE)
    dealt = _in_blocks(_keyed(units, tables, projections, length, seed), block)
    found = dealt.groupBy("tab", "key", "first", "second").applyInArrow(lambda t: _closest(t, m), EDGE)
    # dealt by song once, for both steps; a pair that met in several tables may differ in the last digit
    found = found.repartition("src").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)
    return materialise(ranked.select("src", "dst", "weight"), "neighbours")


def undirected(edges: DataFrame) -> DataFrame:
    """One edge (src < dst) for two songs of which either has the other as a neighbour; negative weights become 0."""
    pair = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.greatest("weight", F.lit(0.0)).alias("weight"))
    return pair.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def strongest(edges: DataFrame, share: float = DEFAULTS.similarity_keep) -> DataFrame:
    """The edges from the (1 - share) quantile of the weights on, which a sketch gives within 1 % of rank."""
    sketch = edges.agg(F.kll_sketch_agg_double("weight", F.lit(SKETCH_SIZE)).alias("s"), F.count(F.lit(1)).alias("n"))
    limit = sketch.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", F.lit(1.0 - share))).alias("limit")).first()[0]
    return edges if limit is None else edges.where(F.col("weight") >= limit)


def communities(edges: DataFrame, k: int = DEFAULTS.n_clusters, rounds: int = 20) -> DataFrame:
    """(id, community) of every song with an edge of positive weight, from undirected edges."""
    some = edges.where("weight > 0")
    if some.isEmpty():
        return edges.sparkSession.createDataFrame([], "id bigint, community int")
    method = PowerIterationClustering(k=k, maxIter=rounds, initMode="random", srcCol="src", dstCol="dst", weightCol="weight")
    return method.assignClusters(some).select("id", F.col("cluster").alias("community"))
