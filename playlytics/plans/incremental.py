"""A history that grows: added plays rewrite the months they fall in, and nothing else.

Every stored table is partitioned by local month, and a month's rows depend on the plays of that month alone. ``pieces`` holds the
plays with their sessions as if each month of a history stood by itself. What the months mean for each other, a session that goes on over
the turn of a month, the number of sessions before, the play before the first, follows from ``ends``, which has one row per history and month,
when the sessions are read: a late play that joins two sessions, or shifts the numbers of all later ones, changes no other month's rows.

The other tables are counts per month that roll up: ``lengths`` of the sessions that lie inside their month (those at its ends
follow from ``ends``), ``clusters`` and ``songs`` played, and ``steps`` from cluster to cluster. The month statistics, shares, diversity,
personality scores and graphs are made of these counts without reading a play.

Plays come in named batches. A batch that is added again replaces its rows, so one that failed half-way is simply repeated.
Tables are replaced with dynamic partition overwrite: a month is swapped when its files are complete.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.operators import graph, stats, traits
from playlytics.operators.joins import null_safe_join
from playlytics.operators.sessions import ORDER, edge_pieces, join_chunks, order_within_sessions
from playlytics.sources import storage

MONTH = ("year", "month")
TABLES = ("pieces", "ends", "lengths", "clusters", "songs", "steps")
BATCH = "batch"


@dataclass(frozen=True)
class History:
    """Where a growing history is stored, and what its sessions are."""

    path: str
    by: tuple[str, ...] = ()
    gap_us: int = DEFAULTS.session_gap_us
    previous: tuple[str, ...] = ("cluster",)
    order: tuple[str, ...] = ORDER

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"


def add_plays(history: History, plays: DataFrame, batch: str) -> list[tuple[int, int]]:
    """Add the plays (with ``year``, ``month`` and ``cluster``) of a batch; returns the months that were rewritten.

    Plays without a time belong to no month and are an error.
    """
    spark = plays.sparkSession
    with storage.scratch_scope(spark):
        dated = F.when(F.col("dt").isNotNull(), F.col("dt")).otherwise(F.raise_error(F.lit("a play has no time")).cast("timestamp"))
        new = storage.materialise(plays.withColumns({"dt": dated, BATCH: F.lit(batch)}), "batch")
        left, before = _touched(spark, history, new, batch)
        months = sorted({*left, *before})
        if not months:
            return []
        rows = new
        if storage.exists(spark, history.table("pieces")):
            stored = spark.read.parquet(history.table("pieces")).where(_in(months) & (F.col(BATCH) != batch))
            rows = new.unionByName(stored.select(new.columns))
        if set(before) - set(left):  # the batch was added before, in months that it has left: other batches may still be there
            left = sorted((r["year"], r["month"]) for r in rows.select(*MONTH).distinct().collect())
        if left:
            order = [c for c in history.order if c in rows.columns]
            pieces = order_within_sessions(rows, history.gap_us, (*history.by, *MONTH), history.previous, order=order, written=True)
            storage.replace_months(pieces, history.table("pieces"))
            _count_months(spark, history, left)
        for year, month in set(months) - set(left):  # a batch that was corrected may leave a month without plays
            for name in TABLES:
                storage.delete_month(spark, history.table(name), year, month)
    return months


Months = list[tuple[int, int]]


def _touched(spark: SparkSession, history: History, new: DataFrame, batch: str) -> tuple[Months, Months]:
    """The months of the batch, now and when it was added before; noted before anything else is written."""
    path = history.table("batches")
    found = {(r["year"], r["month"]) for r in new.select(*MONTH).distinct().collect()}
    before: set[tuple[int, int]] = set()
    if storage.exists(spark, path):
        before = {(r["year"], r["month"]) for r in spark.read.parquet(path).where(F.col("name") == batch).collect()}
    if found - before:
        rows = spark.createDataFrame([(batch, *m) for m in sorted(found - before)], "name string, year int, month int")
        rows.write.mode("append").parquet(path)
    return sorted(found), sorted(before)


def _in(months: Sequence[tuple[int, int]]) -> Column:
    """A filter on partitions; a history has few hundred months."""
    years: dict[int, list[int]] = {}
    for year, month in months:
        years.setdefault(year, []).append(month)
    return reduce(or_, [(F.col("year") == y) & F.col("month").isin(sorted(m)) for y, m in sorted(years.items())])


def _count_months(spark: SparkSession, history: History, months: Sequence[tuple[int, int]]) -> None:
    """Write the counts of the touched months, all of which have plays."""
    key = (*history.by, *MONTH)
    pieces = spark.read.parquet(history.table("pieces")).where(_in(months))
    us, in_head = F.unix_micros("dt"), F.col("session") == 0
    ends = pieces.groupBy(*key).agg(
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.max(F.when(in_head, F.unix_micros("ses_end"))).alias("head_end"),
        F.max(F.when(in_head, F.col("ses_len"))).alias("head_len"),
        F.max("session").alias("last_piece"),
        F.max_by(F.unix_micros("ses_start"), "session").alias("tail_start"),
        F.max_by("ses_len", "session").alias("tail_len"),
        F.min_by("cluster", F.struct("session", "n_within_ses")).alias("first_cluster"),
        *[F.max_by(c, F.struct("session", "n_within_ses")).alias(f"last_{c}") for c in history.previous],
    )
    storage.replace_months(ends, history.table("ends"))
    last = spark.read.parquet(history.table("ends")).where(_in(months)).select(*key, "last_piece")
    # a session is told by its first play; those at the ends of a month may go on in another
    starts = pieces.where("n_within_ses = 0").select(*key, "session", "ses_len")
    inside = null_safe_join(starts, last, key, "inner").where("session > 0 and session < last_piece")
    lengths = inside.groupBy(*MONTH, "ses_len").agg(F.count(F.lit(1)).alias("n_ses"))
    # a month without such sessions has a row as well, so that its earlier rows are replaced
    none = spark.createDataFrame([(*m, None, 0) for m in months], "year int, month int, ses_len bigint, n_ses bigint")
    storage.replace_months(lengths.unionByName(none), history.table("lengths"))
    if "cluster" in history.previous:
        steps = graph.graph_edges(pieces, MONTH)
        none = spark.createDataFrame([(*m, 0) for m in months], "year int, month int, weight bigint")
        storage.replace_months(steps.unionByName(none, allowMissingColumns=True), history.table("steps"))
    songs = pieces.groupBy(*MONTH, "cluster", "g_id").agg(F.count(F.lit(1)).alias("n"))
    storage.replace_months(songs, history.table("songs"))
    songs = spark.read.parquet(history.table("songs")).where(_in(months))
    storage.replace_months(songs.groupBy(*MONTH, "cluster").agg(F.sum("n").alias("n")), history.table("clusters"))


def _read(spark: SparkSession, history: History, name: str, year: int | None = None, month: int | None = None) -> DataFrame:
    df = spark.read.parquet(history.table(name))
    return df if year is None else df.where((F.col("year") == year) & (F.col("month") == month))


def _turns(spark: SparkSession, history: History) -> tuple[DataFrame, DataFrame]:
    """For every month of a history with several: what lies before it, and its sessions that reach into other months."""
    chunk = F.col("year") * 12 + F.col("month") - 1
    split = join_chunks(_read(spark, history, "ends").withColumn("chunk", chunk), history.gap_us, history.by, history.previous)
    in_order = F.coalesce(F.col("first_us") >= F.col("prev_last"), F.lit(True))
    wrong = F.raise_error(F.lit("the months of a history overlap in time")).cast("bigint")
    split = storage.materialise(split.withColumn("base", F.when(in_order, F.col("base")).otherwise(wrong)), "turns")
    edges = edge_pieces(split, history.by).withColumns({"year": F.expr("chunk div 12").cast("int"), "month": (F.col("chunk") % 12 + 1).cast("int")})
    return split, edges.drop("chunk")


def read_sessions(spark: SparkSession, history: History, year: int | None = None, month: int | None = None) -> DataFrame:
    """The plays, or those of a month, with the columns of ``order_within_sessions`` over the whole history."""
    pieces = _read(spark, history, "pieces", year, month)
    split, edges = _turns(spark, history)
    key = (*history.by, *MONTH)
    carried = [f"carried_{c}" for c in history.previous]
    # both ends of a month in one row, so that the plays are joined once
    fields = ("edge_start", "edge_end", "edge_len", "offset")
    ends = edges.groupBy(*key).agg(F.collect_list(F.struct("piece", *fields)).alias("ends"))
    turns = null_safe_join(split.select(*key, "base", "head_break", "prev_last", *carried), ends, key)
    joined = null_safe_join(pieces.withColumnRenamed("session", "piece"), storage.materialise(turns, "month-turns"), key)
    own = F.get(F.filter("ends", lambda e: e["piece"] == F.col("piece")), F.lit(0))
    joined = joined.withColumn("own", own).select("*", *[F.col(f"own.{c}").alias(c) for c in fields])
    is_first = F.col("timediff_us").isNull()  # of the month
    goes_on = is_first & F.coalesce(F.col("head_break") == 0, F.lit(False))
    start, end = (F.coalesce(F.timestamp_micros(e), F.col(c)) for e, c in (("edge_start", "ses_start"), ("edge_end", "ses_end")))
    since = F.unix_micros("dt") - F.col("prev_last")
    added = {
        "session": F.col("piece") + F.coalesce("base", F.lit(0)),
        "ses_start": start,
        "ses_end": end,
        "ses_dur_us": F.unix_micros(end) - F.unix_micros(start),
        "ses_len": F.coalesce("edge_len", "ses_len"),
        "n_within_ses": F.col("n_within_ses") + F.coalesce("offset", F.lit(0)),
        "timediff_us": F.when(is_first, since).otherwise(F.col("timediff_us")),
        **{f"prev_{c}": F.when(goes_on, F.col(f"carried_{c}")).otherwise(F.col(f"prev_{c}")) for c in history.previous},
    }
    plays = [c for c in pieces.columns if c not in added and c != BATCH]
    return joined.select(*plays, *[value.alias(name) for name, value in added.items()])


def read_month_stats(spark: SparkSession, history: History, ignore_nulls: bool = False) -> DataFrame:
    """``stats.month_stats`` of the whole history from the stored counts: no play is read."""
    split, edges = _turns(spark, history)
    key = (*history.by, *MONTH)
    ends = null_safe_join(_read(spark, history, "ends"), split.select(*key, "base"), key)
    part = lambda number, n: F.struct(number.cast("bigint").alias("piece"), F.col(n).alias("n"))
    both = F.when(F.col("last_piece") > 0, F.array(part(F.lit(0), "head_len"), part(F.col("last_piece"), "tail_len")))
    both = F.coalesce(both, F.array(part(F.lit(0), "head_len")))
    last_session = (F.coalesce("base", F.lit(0)) + F.col("last_piece")).alias("last_session")
    outer = null_safe_join(ends.select(*key, last_session, F.inline(both)), edges.select(*key, "piece", "edge_len"), [*key, "piece"])
    outer = outer.groupBy(*MONTH, F.coalesce("edge_len", "n").alias("ses_len")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_ses"), F.max("last_session").alias("last_session")
    )
    inner = _read(spark, history, "lengths").where("n_ses > 0")
    inner = inner.select(*MONTH, "ses_len", (F.col("ses_len") * F.col("n_ses")).alias("n"), "n_ses", F.lit(None).cast("bigint").alias("last_session"))
    lengths = inner.unionByName(outer).groupBy(*MONTH, "ses_len").agg(
        F.sum("n").alias("n"), F.sum("n_ses").alias("n_ses"), F.max("last_session").alias("last_session")
    )
    return stats.month_summary(lengths, _read(spark, history, "clusters"), bool(history.by), ignore_nulls=ignore_nulls)


def read_cluster_month(spark: SparkSession, history: History, labels: DataFrame) -> DataFrame:
    """``stats.cluster_month`` from the stored counts."""
    return stats.cluster_shares(_read(spark, history, "clusters").withColumnRenamed("n", "n_cluster_plays"), labels)


def read_diversity(spark: SparkSession, history: History) -> DataFrame:
    """``stats.diversity`` from the stored counts."""
    return stats.diversity_of(_read(spark, history, "clusters"))


def read_big5(spark: SparkSession, history: History, trait_table: DataFrame) -> DataFrame:
    """``traits.big5_by_month`` from the stored counts."""
    counts = _read(spark, history, "songs").groupBy(*MONTH, "g_id").agg(F.sum("n").alias("n"))
    return traits.big5_of_counts(counts, trait_table)


def read_graph(
    spark: SparkSession, history: History, labels: DataFrame, per: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph, or with ``per`` those of every month, from the stored counts."""
    split, _ = _turns(spark, history)
    key = (*history.by, *MONTH)
    # the first play of a month may go on a session, as the play before it was of another month
    turns = null_safe_join(
        split.where("head_break = 0 and prev_last is not null").select(*key, F.col("carried_cluster").alias("prev_cluster")),
        _read(spark, history, "ends").select(*key, F.col("first_cluster").alias("cluster")),
        key,
    )
    turns = turns.dropna(subset=["prev_cluster", "cluster"]).select(*MONTH, "prev_cluster", "cluster", F.lit(1).cast("bigint").alias("weight"))
    steps = _read(spark, history, "steps").where("weight > 0").unionByName(turns)
    edges = steps.groupBy(*per, "prev_cluster", "cluster").agg(F.sum("weight").alias("weight"))
    played = _read(spark, history, "clusters").dropna(subset=["cluster"])
    nodes = played.select(*per, "cluster", F.col("n").alias("weight"))
    if per:
        ends = edges.select(*per, F.col("prev_cluster").alias("cluster"), F.lit(0).cast("bigint").alias("weight"))
        nodes = nodes.unionByName(ends)
    nodes = nodes.groupBy(*per, "cluster").agg(F.sum("weight").alias("weight")).join(labels, "cluster", "left")
    return nodes.select(*per, "cluster", F.col("cluster_label").alias("name"), "weight"), edges


def read_song_counts(spark: SparkSession, history: History, per: Sequence[str] = ()) -> DataFrame:
    """Plays, distinct songs and the most played song per cluster (and ``per``, of year and month), rolled up from the months."""
    songs = _read(spark, history, "songs").groupBy(*per, "cluster", "g_id").agg(F.sum("n").alias("n"))
    return songs.groupBy(*per, "cluster").agg(
        F.sum("n").alias("n_plays"),
        F.count(F.lit(1)).alias("n_unique_plays"),
        stats.most_frequent("g_id", "n").alias("top_song_id"),
    )
