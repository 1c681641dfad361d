"""Representative songs of the clusters, their covers, and song metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.functions.images import image_url
from playlytics.functions.text import display_names
from playlytics.sources.storage import materialise

PLAY_ORDER = ("dt", "source", "play_id", "song", "artist", "album")


def closest_songs(distances: DataFrame, n: int = DEFAULTS.n_representatives, per: Sequence[str] = ()) -> DataFrame:
    """Songs at one of the ``n`` smallest distances of their cluster (and period); songs at equal distance are all kept.

    The n-th distance is found on distinct distances and joined back, so that no task sees a whole cluster
    and a group of copies of any size passes through.
    """
    known = distances.where(F.col("centroid_dist").isNotNull())
    # one row per cluster, written so that Catalyst sees how few
    limits = materialise(distance_limits(known, n, per), "limits")
    return known.join(limits, [*per, "cluster"]).where(F.col("centroid_dist") <= F.col("limit")).drop("limit")


def distance_limits(known: DataFrame, n: int, per: Sequence[str] = ()) -> DataFrame:
    """The ``n``-th smallest distinct distance of each cluster (and period)."""
    group = [*per, "cluster"]
    ranked = Window.partitionBy(*group).orderBy("centroid_dist")
    best = known.select(*group, "centroid_dist").distinct().withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= n)
    return best.groupBy(*group).agg(F.max("centroid_dist").alias("limit"))


def representative_songs(
    distances: DataFrame,
    plays: DataFrame,
    songs: DataFrame,
    per: Sequence[str] = (),
    n: int = DEFAULTS.n_representatives,
    rank_within: bool = False,
) -> DataFrame:
    """Closest songs of each cluster that were played and have metadata, one row each (per period).

    Closeness is ranked over all songs before the period is looked at, so a period may show fewer than ``n``; with
    ``rank_within`` it is ranked over the songs played in the period. Song, artist and album are those of the first play.
    """
    keys = ["g_id"]
    if rank_within:
        keys = [*per, "g_id"]
        heard = plays.select(*keys).distinct().join(distances.select("g_id", "cluster", "cluster_label", "centroid_dist"), "g_id")
        candidates = materialise(closest_songs(materialise(heard, "heard"), n, per), "closest")
    else:
        candidates = materialise(closest_songs(distances, n), "closest")
    first = F.min_by(F.struct("song", "artist", "album"), F.struct(*PLAY_ORDER)).alias("first")
    played = (
        plays.select(*per, "g_id", *PLAY_ORDER)
        .join(candidates, keys)
        .groupBy(*per, "cluster", "cluster_label", "g_id", "centroid_dist")
        .agg(first)
    )
    return played.join(songs.select(F.col("id").alias("g_id")), "g_id", "left_semi").select(
        *per, "cluster", "cluster_label", F.col("g_id").alias("id"), "centroid_dist", "first.*"
    )


def cluster_covers(representatives: DataFrame, songs: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """The closest song of each cluster and its image, empty when it has none: one row per cluster (and period)."""
    keys = [*per, "cluster"]
    nearest = representatives.groupBy(*keys, "cluster_label").agg(
        F.min_by(F.struct("id", "song", "artist"), F.struct("centroid_dist", "id")).alias("s")
    ).select(*keys, "cluster_label", "s.*")
    covers = materialise(nearest, "covers")
    images = song_images(songs.join(covers.select("id").distinct(), "id", "left_semi"))
    return covers.join(images, "id", "left").select(
        *keys, "cluster_label", "id", "song", "artist", F.coalesce("image", F.lit("")).alias("image")
    )


def song_images(songs: DataFrame) -> DataFrame:
    return songs.select("id", image_url(F.col("art_url"), F.col("header_url")).alias("image"))


def song_metadata(hits: DataFrame, songs: DataFrame) -> DataFrame:
    """Search hits with their songs' metadata, in search and rank order. ``hits`` is a few rows per search."""
    found = songs.join(materialise(hits.select("search", "rank", "id"), "hits"), "id")
    return found.select(
        "search",
        "rank",
        F.col("title").alias("song"),
        F.col("artist_names").alias("artist"),
        F.col("album_name").alias("album"),
        "release_date",
        "url",
    ).orderBy("search", "rank")


def search_result_table(metadata: DataFrame) -> DataFrame:
    return display_names(metadata)
