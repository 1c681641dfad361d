"""Plays of both sources, matched to songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlytics.functions.text import uri_field

PLAY_COLUMNS = ("dt", "song", "album", "artist", "g_id", "source", "play_id", "listener")


def stream_plays(streams: DataFrame) -> DataFrame:
    return streams.select(
        F.col("ts").alias("dt"),
        uri_field(F.col("track_uri")).alias("id"),
        F.col("track_name").alias("song"),
        F.col("album_name").alias("album"),
        F.col("artist_name").alias("artist"),
        "source",
        "play_id",
        "listener",
    )


def match_plays(
    streams: DataFrame, scrobbles: DataFrame, stream_matches: DataFrame, scrobble_matches: DataFrame
) -> DataFrame:
    """All plays of both sources, each with its song id or NULL.

    A match key that occurs twice doubles its plays, and a play present in both sources counts twice.
    The joins are plain, so that AQE can broadcast a small match table and split a hot song of a large one.
    """
    streamed = stream_plays(streams).join(stream_matches.select("id", "g_id"), "id", "left")
    scrobbled = scrobbles.join(scrobble_matches.select("song", "artist", "g_id"), ["song", "artist"], "left")
    return streamed.select(*PLAY_COLUMNS).unionByName(scrobbled.select(*PLAY_COLUMNS))


def cluster_plays(plays: DataFrame, song_clusters: DataFrame) -> DataFrame:
    """Every play with the cluster of its song, NULL without one."""
    return plays.join(song_clusters.select("g_id", "cluster"), "g_id", "left")
