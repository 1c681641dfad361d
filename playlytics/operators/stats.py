"""Statistics per cluster and per month. Every count is combined before it is shuffled by a hot key.

``by`` names the listener columns that, with ``session``, identify a session; ``per`` adds grouping columns,
so ``per=("year", "month")`` gives every month's result at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlytics.functions.calendar import month_start
from playlytics.operators.joins import null_safe_join
from playlytics.sources.storage import materialise

MONTH = ("year", "month")


def most_frequent(value: str, n: str, ignore_nulls: bool = False) -> Column:
    """The value with the largest count, the smallest of equals; NULL competes unless it is ignored."""
    rank = F.struct(F.col(n), -F.col(value))
    if ignore_nulls:
        rank = F.when(F.col(value).isNotNull(), rank)
    return F.max_by(value, rank)


def cluster_stats(
    plays: DataFrame,
    centroids: DataFrame,
    by: Sequence[str] = (),
    per: Sequence[str] = (),
) -> DataFrame:
    """Plays, distinct songs, sessions touched, top song and share of plays per cluster.

    Clusters without plays appear with zeros; plays without a cluster form a row of their own with NULL
    cluster, and count in the denominator of ``freq``. A missing song id counts as one distinct song.
    ``centroids`` has one row per cluster.
    """
    group = [*per, "cluster"]
    # one pass over plays: they are counted by song and by session, each combined before its shuffle
    by_song = [*group, "g_id"]
    by_session = [*group, *by, "session"]
    counts = plays.groupingSets([by_song, by_session], *dict.fromkeys(by_song + by_session)).agg(
        (F.grouping("g_id") == 0).alias("is_song"), F.count(F.lit(1)).alias("n")
    )
    of_songs = F.when(F.col("is_song"), F.col("n"))
    found = counts.groupBy(*group).agg(
        F.sum(of_songs).alias("n_plays"),
        F.count_if("is_song").alias("n_unique_plays"),
        F.max_by("g_id", F.when(F.col("is_song"), F.struct(F.col("n"), -F.col("g_id")))).alias("top_song_id"),
        F.count_if(~F.col("is_song")).alias("n_sessions"),
    )
    # at most (clusters + 1) rows per value of ``per`` from here on
    found = found.withColumn("freq", F.col("n_plays") / F.sum("n_plays").over(Window.partitionBy(*per)))
    wanted = centroids.select("cluster")
    if per:
        periods = found.select(*per).distinct()
        listed = centroids.agg(F.collect_list("cluster").alias("clusters"))
        wanted = periods.withColumn("cluster", F.explode(listed.scalar()))
    numbers = ["freq", "n_plays", "n_unique_plays", "n_sessions"]
    return (
        found.join(wanted, group, "full")
        .join(centroids, "cluster", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
        .select(*per, "cluster", "cluster_label", *numbers, "top_song_id", "centroid")
    )


def cluster_pie(stats: DataFrame) -> DataFrame:
    return stats.select(F.concat(F.lit("Cluster "), "cluster_label").alias("label"), "n_plays")


def _indices() -> list[Column]:
    """Diversity of counts ``n`` with shares ``p``: Gini-Simpson, Shannon (base 2) and inverse Berger-Parker."""
    p, n = F.col("p"), F.col("n").cast("decimal(19,0)")
    square = (n * n).cast("decimal(38,0)")
    total = F.sum("n").cast("double")
    return [
        # squares of counts add up exactly, so the order of rows does not show in the last digit
        (F.lit(1.0) - F.sum(square).cast("double") / (total * total)).alias("gini"),
        F.sum(-p * F.log2(p)).alias("shannon"),
        (F.lit(1.0) / F.max(p)).alias("berger"),
    ]


def _shares(counts: DataFrame, per: Sequence[str]) -> DataFrame:
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*per)))


def diversity(plays: DataFrame, per: Sequence[str] = MONTH) -> DataFrame:
    """Diversity of the clusters played; unclustered plays are a group of their own."""
    return diversity_of(plays.groupBy(*per, "cluster").agg(F.count(F.lit(1)).alias("n")), per)


def diversity_of(counts: DataFrame, per: Sequence[str] = MONTH) -> DataFrame:
    """The same from counts (per, cluster, n)."""
    return _shares(counts, per).groupBy(*per).agg(*_indices())


def month_stats(
    sessions: DataFrame, by: Sequence[str] = (), per: Sequence[str] = MONTH, ignore_nulls: bool = False
) -> DataFrame:
    """Plays, sessions, session lengths, modal cluster and diversity per month.

    ``n_sessions`` is the number of sessions up to the month's last one, ``n_sessions_in_month`` those with
    plays in it. ``ses_len_median`` is taken over plays, ``ses_len_median_sessions`` over sessions. With
    several histories (``by``) session numbers start anew, so ``n_sessions`` counts the month's sessions too.
    """
    # the only pass over plays: everything else comes from these counts
    counts = sessions.groupBy(*per, *by, "session", "ses_len", "cluster").agg(F.count(F.lit(1)).alias("n"))
    pieces = counts.groupBy(*per, *by, "session", "ses_len").agg(F.sum("n").alias("n"))
    # exact medians from counts of equal lengths: the state grows with distinct lengths, not with plays
    lengths = pieces.groupBy(*per, "ses_len").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_ses"), F.max("session").alias("last_session")
    )
    clusters = counts.groupBy(*per, "cluster").agg(F.sum("n").alias("n"))
    return month_summary(lengths, clusters, bool(by), per, ignore_nulls)


def month_summary(
    lengths: DataFrame, clusters: DataFrame, several: bool, per: Sequence[str] = MONTH, ignore_nulls: bool = False
) -> DataFrame:
    """Month statistics from counts alone: ``lengths`` (per, ses_len, n plays, n_ses, last_session) and ``clusters`` (per, cluster, n)."""
    n_sessions = F.sum("n_ses") if several else F.max("last_session") + 1
    summary = lengths.groupBy(*per).agg(
        F.sum("n").alias("n_plays"),
        n_sessions.alias("n_sessions"),
        F.sum("n_ses").alias("n_sessions_in_month"),
        F.expr("percentile(ses_len, 0.5, n)").alias("ses_len_median"),
        F.expr("percentile(ses_len, 0.5, n_ses)").alias("ses_len_median_sessions"),
        F.max("ses_len").alias("ses_len_max"),
    )
    modes = _shares(clusters, per).groupBy(*per).agg(
        most_frequent("cluster", "n", ignore_nulls).alias("cluster_mode"),
        F.max(F.when(F.col("cluster").isNotNull(), F.col("n"))).alias("largest"),
        *_indices(),
    )
    # a NULL mode equals no row, so its count is 0
    mode_count = F.when(F.col("cluster_mode").isNull(), F.lit(0)).otherwise(F.col("largest"))
    return (
        summary.join(modes, list(per))
        .withColumn("cluster_mode_count", mode_count)
        .withColumn("cluster_mode_freq", F.col("cluster_mode_count") / F.col("n_plays"))
        .withColumn("date", month_start())
        .select(
            "date",
            *per,
            "n_plays",
            "n_sessions",
            "n_sessions_in_month",
            "ses_len_median",
            "ses_len_median_sessions",
            "ses_len_max",
            "cluster_mode",
            "cluster_mode_count",
            "cluster_mode_freq",
            "gini",
            "shannon",
            "berger",
        )
    )


def cluster_month(plays: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of each cluster in the month's plays; unclustered plays count in the denominator only."""
    return cluster_shares(plays.groupBy(*MONTH, "cluster").agg(F.count(F.lit(1)).alias("n_cluster_plays")), labels)


def cluster_shares(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """The same from counts (year, month, cluster, n_cluster_plays)."""
    shares = counts.withColumn(
        "cluster_freq", F.col("n_cluster_plays") / F.sum("n_cluster_plays").over(Window.partitionBy(*MONTH))
    )
    return shares.join(labels, "cluster").select(
        *MONTH, month_start().alias("date"), "cluster", "cluster_label", "n_cluster_plays", "cluster_freq"
    )


def timebin_month(plays: DataFrame) -> DataFrame:
    counts = plays.groupBy(*MONTH, "timebin_no", "timebin").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("date", month_start()).orderBy("timebin_no", "date")


def hour_histogram(plays: DataFrame, labels: DataFrame) -> DataFrame:
    """Plays per hour and cluster with zeros for empty pairs; unclustered plays are not shown."""
    grid = labels.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    counts = plays.groupBy("cluster", "hour").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["cluster", "hour"], "left").select(
        "hour", "cluster", "cluster_label", F.coalesce("count", F.lit(0)).alias("count")
    )
