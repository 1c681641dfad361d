"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.sources.storage import materialise

__all__ = ["components", "free_name", "materialise", "read", "sorted_groups", "text_column"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def text_column(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def sorted_groups(
    tables: Iterable[pa.RecordBatch], keys: Sequence[str], schema: pa.Schema, handle: Callable[[pa.Table], Iterator[pa.RecordBatch]]
) -> Iterator[pa.RecordBatch]:
    """Cut a stream of batches, sorted by ``keys``, between groups, and hand on tables of whole groups.

    Only the last, still open group waits for the next batch, so memory is bounded by a batch and a group.
    """
    waiting: list[pa.Table] = []
    last = None
    for batch in tables:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        if waiting and marks[0] != last:
            yield from handle(pa.concat_tables(waiting))
            waiting = []
        cut = len(marks)
        while cut and marks[cut - 1] == marks[-1]:
            cut -= 1
        if cut:
            yield from handle(pa.concat_tables([*waiting, table.slice(0, cut)]))
            waiting = []
        waiting.append(table.slice(cut))
        last = marks[-1]
    if waiting:
        yield from handle(pa.concat_tables(waiting))


_PLANE = 32_768  # bits of one row of Spark's bitmap functions
_MOST_BITS = 1 << 27


def may_be_in(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false only where ``df``'s string ``key`` is not among the column ``key`` of ``keys``.

    The keys are hashed into a bitmap of 16 bits a key, 16 MB at most, that is broadcast, so most rows that have no partner
    need not be shuffled to find that out. Beyond 8 million keys it lets more rows pass.
    """
    n, bits = keys.count(), _PLANE
    while bits < min(16 * n, _MOST_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    planes = keys.select(slot.alias("slot")).groupBy(F.expr(f"slot div {_PLANE}").alias("plane"))
    planes = planes.agg(F.expr(f"bitmap_construct_agg(slot % {_PLANE})").alias("plane_bits"))
    planes = materialise(planes, "bitmap")
    place = F.expr(f"pmod(xxhash64({key}), {bits}) % {_PLANE}")
    plane, bytes_ = free_name(df, "plane"), free_name(df, "plane_bits")
    planes = planes.select(F.col("plane").alias(plane), F.col("plane_bits").alias(bytes_))
    byte = F.conv(F.hex(F.substring(F.col(bytes_), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    met = df.withColumn(plane, F.expr(f"pmod(xxhash64({key}), {bits}) div {_PLANE}")).join(F.broadcast(planes), plane, "left")
    return met.withColumn(name, held).drop(plane, bytes_)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), one per node that has an edge.

    Rounds of contraction: every node moves to the neighbour (or itself) that comes first in an order drawn
    anew for the round, edges are renamed and loops dropped, until none is left; a round removes a constant
    share of the nodes. Only counts reach the driver. A hub is combined before it shuffles, and the joins
    put its edges against one row, so a hot one can be split.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, n=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", rank("b").alias("to")).union(edges.select(F.col("b").alias("a"), rank("a").alias("to")))
        best = both.groupBy("a").agg(F.min("to").alias("to")).select(F.col("a").alias("node"), F.least("to", rank("a"))["n"].alias("root"))
        moved = materialise(best, f"{name}-moves")
        moves.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
        renamed = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialise(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialise(found, f"{name}-roots")


def with_text_columns(
    df: DataFrame, added: str, compute: Callable[[list[bytes | None]], Sequence[pa.Array]], text: str = "text"
) -> DataFrame:
    """``df`` with columns ``added`` (a DDL list) that ``compute`` derives from runs of whole texts.

    Rows are handed on as they come: nothing is shuffled, and a run holds about ``RUN_BYTES`` of text or one text.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    clash = {f.name.lower() for f in new} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the table already has columns named {sorted(clash)}")
    schema = StructType([*df.schema.fields, *new.fields])
    at = df.columns.index(text)
    # the JVM fills a batch up to this size before it sends it, whatever the number of rows
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(RUN_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            sizes = [len(t or b"") for t in texts]
            while first < len(texts):
                end, total = first, 0
                while end < len(texts) and (end == first or total + sizes[end] <= RUN_BYTES):
                    total += sizes[end]
                    end += 1
                arrays = list(compute(texts[first:end]))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[f.name for f in schema])
                first = end

    return df.mapInArrow(run, schema)


RUN_BYTES = 4 << 20
