"""Parameters of the engine and the session settings it relies on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

# Results depend on them.
TIME_BIN_LABELS = ("morning", "midday", "evening", "night")
TRAITS = ("Openness to Experience", "Conscientiousness", "Extraversion", "Agreeableness", "Neuroticism")
TRAITS_SHORT = ("O", "C", "E", "A", "N")
TRAITS_POSITIVE = ("Open to experience", "Organized", "Extraverted", "Agreeable", "Neurotic")
TRAITS_NEGATIVE = ("Closed to experience", "Messy", "Introverted", "Disagreeable", "Emotionally stable")
TRAIT_COLUMNS = ("opn", "con", "ext", "agr", "neu")
DEFAULT_COVER = "default_cover_image"
BOOKKEEPING_PREFIX = "_dlt_"
SEARCH_TASK = "search result"
PROMPT = ("task: ", " | query: ")


@dataclass(frozen=True)
class Settings:
    time_zone: str = "US/Eastern"
    n_clusters: int = 7
    seed: int = 1738
    session_gap_us: int = MICROS_PER_DAY
    # hours after the shifted start of day at which a new time bin begins
    time_bin_edges: tuple[int, int, int] = (6, 12, 18)
    time_bin_shift: int = 3
    n_search_results: int = 5
    n_representatives: int = 3
    similarity_keep: float = 0.8


DEFAULTS = Settings()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings on which results (time zone) and skew handling (AQE) depend."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a hot join key even where that costs the aggregate above it one more shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark
