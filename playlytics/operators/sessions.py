"""Listening sessions: runs of plays with at most ``gap`` between neighbours.

Neither the whole history nor a hot listener ever reaches one task:

``assign_sessions`` needs no order of the plays. Plays less than one gap apart in the same time cell (cell
width = gap) cannot be separated by a break, so breaks lie between cells only. Plays are pre-aggregated to
(listener, cell), which has at most one row per listener and gap of elapsed time, and the cells are numbered.

``order_within_sessions`` numbers the plays themselves. Cells and plays are numbered alike: the written rows are
range-partitioned on the whole sort key into chunks of about ``CHUNK_ROWS`` (a hot instant, listener or session
spreads over many chunks) and numbered inside their chunk. A chunk boundary cuts at most one history, so at most
two chunk ends per chunk need correcting; with at most ``MAX_CHUNKS`` chunks these are at most 40,000 rows, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.operators.joins import null_safe_join
from playlytics.sources.storage import materialise

ORDER = ("source", "play_id", "g_id")  # those that the plays have; with ``dt`` a total order
CHUNK_ROWS = 250_000
MAX_CHUNKS = 20_000  # of larger tables the chunks are larger


def session_cells(plays: DataFrame, gap_us: int = DEFAULTS.session_gap_us, by: Sequence[str] = ()) -> DataFrame:
    """One row per history and time cell of width ``gap`` with plays: first and last play and their number."""
    if gap_us < 1:
        raise ValueError("the gap must be at least one microsecond")
    return (
        plays.select(*by, F.unix_micros("dt").alias("us"))
        .groupBy(*by, _cell(F.col("us"), gap_us).alias("cell"))
        .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    )


def _cell(us: Column, gap_us: int) -> Column:
    return us - F.pmod(us, F.lit(gap_us))


def assign_sessions(
    plays: DataFrame, gap_us: int = DEFAULTS.session_gap_us, by: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Add session number, start, end, duration and length to every play.

    ``by=()`` treats all plays as one history; ``by=("listener",)`` numbers each listener's sessions from 0.
    """
    cells = materialise(session_cells(plays, gap_us, by), "cells")
    numbered = _number(cells, gap_us, by, (), ("cell",), chunks).select(*by, "cell", *_session_columns())
    keyed = plays.withColumn("cell", _cell(F.unix_micros("dt"), gap_us))
    return null_safe_join(keyed, numbered, [*by, "cell"]).drop("cell")


def _session_columns() -> list[Column]:
    start, end = F.coalesce("edge_start", "piece_start"), F.coalesce("edge_end", "piece_end")
    return [
        (F.col("piece") + F.coalesce("base", F.lit(0))).alias("session"),
        F.timestamp_micros(start).alias("ses_start"),
        F.timestamp_micros(end).alias("ses_end"),
        (end - start).alias("ses_dur_us"),
        F.coalesce("edge_len", "piece_len").alias("ses_len"),
    ]


def order_within_sessions(
    plays: DataFrame,
    gap_us: int = DEFAULTS.session_gap_us,
    by: Sequence[str] = (),
    previous: Sequence[str] = ("cluster",),
    chunks: int | None = None,
    order: Sequence[str] = ORDER,
    written: bool = False,
) -> DataFrame:
    """Sessions plus everything that depends on the order of plays.

    Adds ``n_within_ses`` (0-based position), ``timediff_us`` (time since the previous play, across sessions)
    and ``prev_<column>`` (value of the previous play in the session, NULL on its first). Plays are ordered
    by ``(dt, *order)``, NULL last; plays equal in all of these may change places. ``written`` says that the plays
    are read from tables as they are, and need not be written for the passes over them.
    """
    if gap_us < 1:
        raise ValueError("the gap must be at least one microsecond")
    us = F.unix_micros("dt")
    # written once: sampling the range bounds then reads this, and does not repeat the joins before it
    rows = plays.withColumns({"first_us": us, "last_us": us, "n": F.lit(1).cast("bigint")})
    rows = rows if written else materialise(rows, "plays")
    joined = _number(rows, gap_us, by, previous, ("first_us", *[c for c in order if c in plays.columns]), chunks)
    continues = F.col("is_first") & (F.col("head_break") == 0)
    return joined.select(
        *plays.columns,
        *_session_columns(),
        (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("n_within_ses"),
        (F.col("first_us") - F.when(F.col("is_first"), F.col("prev_last")).otherwise(F.col("prev_us"))).alias("timediff_us"),
        *[F.when(continues, F.col(f"carried_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in previous],
    )


def _number(
    rows: DataFrame, gap_us: int, by: Sequence[str], previous: Sequence[str], order: Sequence[str], chunks: int | None
) -> DataFrame:
    """Session numbers, bounds and positions of written ``rows`` (first_us, last_us, n plays), ordered by ``order``."""
    if chunks is None:
        n = rows.count()
        chunks = max(1, -(-n // max(CHUNK_ROWS, -(-n // MAX_CHUNKS))))
    group = [*by, "chunk"]
    # the chunk of a row is fixed by writing it: two runs may sample other range bounds
    stored = materialise(_number_chunks(rows, gap_us, by, previous, chunks, order), "ordered")
    split = materialise(_split_histories(stored, gap_us, by, previous), "split")
    fixes = split.select(*group, "base", "head_break", "prev_last", *[f"carried_{c}" for c in previous])
    small = F.broadcast if chunks <= MAX_CHUNKS else lambda df: df
    joined = null_safe_join(stored, small(fixes), group)
    return null_safe_join(joined, small(edge_pieces(split, by)), [*group, "piece"])


def _number_chunks(
    rows: DataFrame, gap_us: int, by: Sequence[str], previous: Sequence[str], chunks: int, order: Sequence[str]
) -> DataFrame:
    """Cut each history into chunks and number the session pieces and positions inside each chunk."""
    key = [F.col(c) for c in by] + [F.col(c).asc_nulls_last() for c in order]
    cut = rows.repartitionByRange(chunks, *key).withColumn("chunk", F.spark_partition_id())
    return _number_pieces(cut, gap_us, by, previous, order)


def _number_pieces(rows: DataFrame, gap_us: int, by: Sequence[str], previous: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the session pieces and positions of each history inside each chunk."""
    group = [*by, "chunk"]
    key = [F.col(c).asc_nulls_last() for c in order]
    in_group = Window.partitionBy(*group).orderBy(*key)
    so_far = in_group.rowsBetween(Window.unboundedPreceding, 0)
    piece = Window.partitionBy(*group, "piece")
    is_break = F.coalesce(F.col("first_us") - F.col("prev_us") > gap_us, F.lit(False))
    inside = F.col("pos") > 0
    return (
        rows.withColumns(
            {
                "prev_us": F.lag("last_us").over(in_group),
                "is_first": F.lag(F.lit(True)).over(in_group).isNull(),
                "is_last": F.lead(F.lit(True)).over(in_group).isNull(),
                "place": F.row_number().over(in_group).cast("bigint"),
                **{f"prev_{c}": F.lag(c).over(in_group) for c in previous},
            }
        )
        .withColumn("is_break", is_break)
        .withColumns(
            {
                "piece": F.sum(F.col("is_break").cast("bigint")).over(so_far),
                # the place of the piece's first row: positions need no order of their own
                "pos": F.col("place") - F.max(F.when(F.col("is_first") | F.col("is_break"), F.col("place"))).over(so_far),
            }
        )
        .withColumns(
            {
                **{f"prev_{c}": F.when(inside, F.col(f"prev_{c}")) for c in previous},
                "piece_start": F.min("first_us").over(piece),
                "piece_end": F.max("last_us").over(piece),
                "piece_len": F.sum("n").over(piece),
            }
        )
        .drop("place", "is_break")
    )


def _split_histories(rows: DataFrame, gap_us: int, by: Sequence[str], previous: Sequence[str]) -> DataFrame:
    """One row per chunk of every history that spans several chunks: at most two per chunk."""
    first = lambda c: F.max(F.when(F.col("is_first"), F.col(c)))
    last = lambda c: F.max(F.when(F.col("is_last"), F.col(c)))
    ends = (
        rows.where(F.col("is_first") | F.col("is_last"))
        .groupBy(*by, "chunk")
        .agg(
            first("first_us").alias("first_us"),
            first("piece_end").alias("head_end"),
            first("piece_len").alias("head_len"),
            last("last_us").alias("last_us"),
            last("piece").alias("last_piece"),
            last("piece_start").alias("tail_start"),
            last("piece_len").alias("tail_len"),
            *[last(c).alias(f"last_{c}") for c in previous],
        )
    )
    return join_chunks(ends, gap_us, by, previous)


def join_chunks(ends: DataFrame, gap_us: int, by: Sequence[str], previous: Sequence[str]) -> DataFrame:
    """What the chunks of a history mean for each other, from the ``ends`` of each chunk: a row per chunk of every history with several.

    ``base`` is added to the piece numbers of the chunk; ``head_break`` tells whether its first play begins a
    session; ``prev_last`` and ``carried_*`` describe the play before it.
    """
    along = Window.partitionBy(*by).orderBy("chunk")
    return (
        ends.withColumns(
            {
                "n_chunks": F.count(F.lit(1)).over(Window.partitionBy(*by)),
                "prev_last": F.lag("last_us").over(along),
                **{f"carried_{c}": F.lag(f"last_{c}").over(along) for c in previous},
                "pieces_before": F.sum("last_piece").over(along.rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        .where(F.col("n_chunks") > 1)
        .withColumn("head_break", F.coalesce(F.col("first_us") - F.col("prev_last") > gap_us, F.lit(False)).cast("bigint"))
        .withColumn(
            "base",
            F.coalesce("pieces_before", F.lit(0)) + F.sum("head_break").over(along.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )


def edge_pieces(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounds and lengths of the sessions at the ends of split chunks, and how much of each lies in earlier chunks."""

    def piece(number, n, start, end):
        return F.struct(
            number.alias("piece"),
            (F.col("base") + number).alias("session"),
            F.col(n).alias("n"),
            F.col(start).alias("start"),
            F.col(end).alias("end"),
        )

    head = piece(F.lit(0).cast("bigint"), "head_len", "first_us", "head_end")
    tail = piece(F.col("last_piece"), "tail_len", "tail_start", "last_us")
    both = F.when(F.col("last_piece") > 0, F.array(head, tail)).otherwise(F.array(head))
    whole = Window.partitionBy(*by, "session")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return split.select(*by, "chunk", F.inline(both)).select(
        *by,
        "chunk",
        "piece",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.min("start").over(whole).alias("edge_start"),
        F.max("end").over(whole).alias("edge_end"),
        F.sum("n").over(whole).alias("edge_len"),
    )
