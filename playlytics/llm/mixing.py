"""Mixing sources to target weights along a curriculum that changes over the training.

Every source has a schedule: knots (time, weight) with straight lines between them, time running from 0 to 1. The
integral of a schedule is the source's weight in the whole mix. The sources share ``share`` times all words by
weight; no target exceeds ``repeats`` times its source, and what is cut off there is shared again by weight.

A source's documents are laid end to end in the order of a hash, copy after copy, and the mix takes words up to the
target (rounded), so that at most one copy of a source is cut short. The word at share x of a target is due at the
time by which the schedule has spent the share x of its integral; solving for that time is the position of a copy,
and copies are range-sorted by it.

Sources are cut into 4,096 pieces by the hash, whose sums are combined before they shuffle; running sums are taken
inside the pieces, so that no source, however large, is ordered in one task.

Words are runs without white space (``[^\\x20\\x09-\\x0D]+``). Null and empty texts have none; they are taken once if
their place is within the target. A null source is a source of its own and comes last. Null ids share a place in
the order. Repeated rows are documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlytics.llm.common import free_name, materialise

Knots = Sequence[tuple[float, float]]

SHARE = 1.5
REPEATS = 2.0
#: Schedules of the sources by code point, in turn; their integrals, the weights, are 3, 1 and 2.
SCHEDULES: tuple[Knots, ...] = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)))
_PIECE_DIGITS = 3  # hexadecimal


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def check_knots(knots: Knots) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError("the knots of a schedule must run from time 0 to time 1")
    if any(w < 0 or not math.isfinite(w) for _, w in knots) or integral(knots) <= 0:
        raise ValueError("the weights of a schedule must not be negative, nor all zero")


def _segments(schedules: Sequence[Knots], number: Column) -> Column:
    """The lines of a schedule: start time, first weight, slope and the integral before it."""
    rows = []
    for knots in schedules:
        before, lines = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            line = {"start": t0, "first": w0, "slope": (w1 - w0) / (t1 - t0), "before": before}
            lines.append(F.struct(*[F.lit(v).alias(k) for k, v in line.items()]))
            before += (t1 - t0) * (w0 + w1) / 2
        rows.append(F.array(*lines))
    return F.element_at(F.array(*rows), number)


def due(segments: Column, spent: Column) -> Column:
    """The time by which a schedule's integral reaches ``spent``."""
    line = F.element_at(F.filter(segments, lambda s: s["before"] <= spent), -1)
    rest = spent - line["before"]
    root = F.sqrt(F.greatest(line["first"] * line["first"] + 2 * line["slope"] * rest, F.lit(0.0)))
    return line["start"] + F.when(rest > 0, 2 * rest / (line["first"] + root)).otherwise(0.0)


def source_targets(
    sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = SHARE, repeats: float = REPEATS
) -> DataFrame:
    """Rows (source, source_size) with each source's number in code point order, target and rounded target.

    The sources are numbered in range partitions; only sums reach the driver.
    """
    for knots in schedules:
        check_knots(knots)
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(sizes.repartitionByRange(ranges, order).withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = placed.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    weights = [integral(k) for k in schedules]
    number = F.row_number().over(Window.partitionBy("range").orderBy(order)) + F.col("start") - 1
    turn = (F.pmod("number", F.lit(len(weights))) + 1).cast("int")
    sources = materialise(
        placed.join(F.broadcast(starts), "range")
        .withColumn("number", number)
        .select("source", "source_size", turn.alias("turn"), F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"))
        .withColumn("most", repeats * F.col("source_size")),
        "sources",
    )
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (share * (total or 0)) / (weight or 1), -1
    while True:  # each round fills sources, or ends
        filled = F.col("weight") * level > F.col("most")
        n, spent, rest = sources.agg(
            F.count(F.when(filled, 1)), F.sum(F.when(filled, F.col("most"))), F.sum(F.when(~filled, F.col("weight")))
        ).first()
        if n == full or not rest:
            break
        level, full = (share * total - (spent or 0.0)) / rest, n
    target = F.least("most", F.col("weight") * level) if total else F.lit(0.0)
    return sources.select("source", "source_size", "turn", target.alias("target"), F.floor(target + 0.5).alias("budget"))


def assign(
    docs: DataFrame,
    schedules: Sequence[Knots] = SCHEDULES,
    share: float = SHARE,
    repeats: float = REPEATS,
    size: str = "size",
    name: str = "mix",
) -> DataFrame:
    """Add ``mix``: source_size, target and the copies taken (copy, words, position) of every row.

    ``docs`` has doc_id, source and the words of the text in ``size``. It is read twice. Where it has a column of that ``name``, the new
    one has underscores in front.
    """
    name = free_name(docs, name)
    key = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"),
        "doc_id",
        F.col(size).alias("words"),
        key.alias("source_key"),
        order.alias("place"),
        F.substring(order, 1, _PIECE_DIGITS).alias("piece"),
    )
    pieces = materialise(
        docs.select("source", key.alias("source_key"), F.substring(order, 1, _PIECE_DIGITS).alias("piece"), F.col(size).alias("words"))
        .groupBy("source", "source_key", "piece")
        .agg(F.sum("words").alias("words")),
        "pieces",
    )
    targets = source_targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, share, repeats)
    before = Window.partitionBy("source_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("source", "source_key", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    known = targets.withColumn("same", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")))
    starts = starts.drop("source").join(known.drop("source"), F.col("source_key") == F.col("same")).drop("same")
    along = Window.partitionBy("source_key", "piece").orderBy("place", "doc_id", "words")
    running = F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = rows.withColumn("running", running).join(starts, ["source_key", "piece"])
    copies = F.sequence(F.lit(0), F.lit(max(0, math.ceil(repeats) - 1)))
    segments = _segments(schedules, F.col("turn"))
    integrals = F.element_at(F.array(*[F.lit(integral(k)) for k in schedules]), F.col("turn"))

    def copy(number: Column) -> Column:
        first = F.col("start") + F.col("running") + number * F.col("source_size")
        return F.struct(
            number.alias("copy"),
            F.greatest(F.lit(0), F.least("words", F.col("budget") - first)).alias("words"),
            first.alias("first"),
        )

    used = F.filter(
        F.transform(copies, copy),
        lambda c: (c["words"] > 0) | ((F.col("words") == 0) & (c["copy"] == 0) & (c["first"] < F.col("budget"))),
    )
    timed = F.transform(
        "used",
        lambda c: F.struct(
            c["copy"].alias("copy"),
            c["words"].alias("words"),
            due(segments, c["first"].cast("double") / F.col("budget") * integrals).alias("position"),
        ),
    )
    return placed.withColumn("used", used).select("doc.*", F.struct("source_size", "target", timed.alias("copies")).alias(name))


def mix(
    docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = SHARE, repeats: float = REPEATS, whole: bool = True
) -> DataFrame:
    """The mixed documents, one row per copy, range-sorted by position.

    With ``whole`` the copy that a target cuts is kept whole if at least half of it is taken and else left out, and the columns
    are those of ``docs``; otherwise ``mix_copy``, ``mix_words`` (the words that count) and ``mix_position`` are added, with underscores in
    front where ``docs`` has such columns.
    """
    size, name, one = (free_name(docs, wish) for wish in ("mix_size", "mix", "mix_taken"))
    taken = assign(docs.withColumn(size, word_count("text")), schedules, share, repeats, size, name)
    copies = taken.select("*", F.explode(f"{name}.copies").alias(one))
    if whole:
        copies = copies.where(2 * F.col(f"{one}.words") >= F.col(size))
    ordered = copies.orderBy(f"{one}.position", "doc_id", f"{one}.copy")
    if whole:
        return ordered.select(docs.columns)
    added = [F.col(f"{one}.{c}").alias(free_name(docs, f"mix_{c}")) for c in ("copy", "words", "position")]
    return ordered.select(*docs.columns, *added)
