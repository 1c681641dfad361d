"""Distance in lyric space between consecutive songs of a session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.functions.calendar import month_start
from playlytics.functions.vectors import l2_distance
from playlytics.sources.storage import materialise


def latent_distance_month(sessions: DataFrame, vectors: DataFrame, per: Sequence[str] = ("year", "month")) -> DataFrame:
    """Mean distance per month over all steps between two songs that both have a vector.

    Steps are counted per month and pair of songs first. Two vectors travel for each distinct pair, and only
    its distance goes back to the months, however often the pair was played. Needs ``prev_g_id`` from ``order_within_sessions(previous=("g_id",))``.
    """
    pair = ["prev_g_id", "g_id"]
    steps = materialise(
        sessions.dropna(subset=pair).groupBy(*per, *pair).agg(F.count(F.lit(1)).alias("n")), "steps"
    )
    start = vectors.select(F.col("id").alias("prev_g_id"), F.col("embedding").alias("a"))
    end = vectors.select(F.col("id").alias("g_id"), F.col("embedding").alias("b"))
    pairs = steps.select(*pair).distinct().join(end, "g_id").join(start, "prev_g_id")
    distances = pairs.select(*pair, l2_distance(F.col("a"), F.col("b")).alias("d"))
    return (
        steps.join(distances, pair)
        .groupBy(*per)
        .agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("latent_dist_mean"), F.sum("n").alias("n_steps"))
        .withColumn("date", month_start())
    )
