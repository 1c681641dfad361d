"""Personality scores of the songs played."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.config import TRAITS, TRAITS_NEGATIVE, TRAITS_POSITIVE, TRAITS_SHORT
from playlytics.functions.calendar import month_start


def trait_names(spark: SparkSession) -> DataFrame:
    rows = zip(range(len(TRAITS)), TRAITS, TRAITS_SHORT, TRAITS_POSITIVE, TRAITS_NEGATIVE)
    return spark.createDataFrame(list(rows), "n int, trait string, trait_short string, trait_pos string, trait_neg string")


def _described(sign: Column) -> Column:
    return F.when(sign >= 0, F.col("trait_pos")).otherwise(F.col("trait_neg"))


def big5_by_month(plays: DataFrame, traits: DataFrame, per: Sequence[str] = ("year", "month")) -> DataFrame:
    """Mean logit over the plays of a month and its tanh, one row per trait.

    Plays are first counted per month and song, so the join meets each song once per month, and the trait
    vector is unpacked after that.
    """
    return big5_of_counts(plays.groupBy(*per, "g_id").agg(F.count(F.lit(1)).alias("n")), traits, per)


def big5_of_counts(counts: DataFrame, traits: DataFrame, per: Sequence[str] = ("year", "month")) -> DataFrame:
    """The same from the number ``n`` of plays per month and song."""
    joined = counts.join(traits.withColumnRenamed("id", "g_id"), "g_id")
    values = joined.select(*per, F.col("n").alias("w"), F.posexplode("outputs").alias("n", "logit"))
    weight = F.when(F.col("logit").isNotNull(), F.col("w"))
    means = values.groupBy(*per, "n").agg((F.sum(F.col("w") * F.col("logit")) / F.sum(weight)).alias("logit"))
    score = F.tanh("logit")
    return means.join(F.broadcast(trait_names(counts.sparkSession)), "n").select(
        month_start().alias("date"),
        "logit",
        "trait",
        "trait_short",
        "trait_pos",
        "trait_neg",
        _described(F.col("logit")).alias("trait_desc"),
        score.alias("score"),
        (F.abs(score) * 100).alias("score_pct"),
    )


def big5_overall(monthly: DataFrame) -> DataFrame:
    """Mean of the monthly scores; the description follows the sign of that mean."""
    return (
        monthly.groupBy("trait_short", "trait", "trait_pos", "trait_neg")
        .agg(F.avg("score").alias("score"))
        .withColumn("trait_desc", _described(F.col("score")))
        .withColumn("score_pct", F.abs("score") * 100)
    )


def big5_of_month(monthly: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    if year is None:
        return big5_overall(monthly)
    return monthly.where(F.col("date") == F.make_date(F.lit(year), F.lit(month), F.lit(1)))
