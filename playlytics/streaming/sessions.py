"""Sessions of a stream of plays: bounds and lengths as in a batch, each session given out once, when it is over.

A session is over when the watermark, the latest time seen less ``delay``, has passed its last play by the gap; until then it is state, one
row per open session and never a play, and a play that comes late joins it or joins two sessions to one. A play
later than the watermark is dropped; ``run_available`` returns how many were, so that a longer ``delay`` can be chosen.

Time moves on with the plays. At the end of a history, or while no plays come, a heartbeat moves it: a time that belongs to no play,
read from a folder of its own. ``end_stream`` writes one that closes all sessions.

All state lies in the checkpoint folder, which with the folder of results must be shared; a run that was lost goes on from there,
and the sink takes each micro-batch once. Plays without a time are not counted. Plays without a listener are one listener.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS, MICROS_PER_SECOND

HEARTBEAT = "is_heartbeat"


def with_heartbeats(plays: DataFrame, folder: str) -> DataFrame:
    """A stream of plays and of the times in ``folder``, a Parquet folder with one column ``dt``."""
    spark = plays.sparkSession
    beats = spark.readStream.schema("dt timestamp").parquet(folder).withColumn(HEARTBEAT, F.lit(True))
    return plays.withColumn(HEARTBEAT, F.lit(False)).unionByName(beats, allowMissingColumns=True)


def write_heartbeat(spark: SparkSession, folder: str, dt: datetime | None = None) -> None:
    """Move the time of a stream to ``dt``; without one the folder is made, as a file source needs it."""
    rows = [(dt,)] if dt else []
    spark.createDataFrame(rows, "dt timestamp").coalesce(1).write.mode("append").parquet(folder)


def stream_sessions(
    plays: DataFrame, gap_us: int = DEFAULTS.session_gap_us, by: Sequence[str] = (), delay: str = "1 day"
) -> DataFrame:
    """(by, ses_start, ses_end, ses_dur_us, ses_len) of every session of a stream, or of a table."""
    if gap_us < 1:
        raise ValueError("the gap must be at least one microsecond")
    is_play = F.lit(True) if HEARTBEAT not in plays.columns else ~F.col(HEARTBEAT)
    window: Column = F.session_window("dt", _interval(gap_us))
    # a stream's session window needs a key beside it; heartbeats must not join plays
    keyed = plays.select("dt", *by, is_play.alias("is_play")).withWatermark("dt", delay)
    found = keyed.groupBy(window.alias("window"), *by, "is_play").agg(
        F.min("dt").alias("ses_start"), F.max("dt").alias("ses_end"), F.count_if("is_play").alias("ses_len")
    )
    duration = F.unix_micros("ses_end") - F.unix_micros("ses_start")
    # a filter on the key would be pushed below the watermark, and heartbeats would move nothing
    return found.where("ses_len > 0").select(*by, "ses_start", "ses_end", duration.alias("ses_dur_us"), "ses_len")


def _interval(us: int) -> str:
    return f"{us // MICROS_PER_SECOND} seconds {us % MICROS_PER_SECOND} microseconds"


def run_available(sessions: DataFrame, path: str, checkpoint: str) -> int:
    """Take in all plays that are there, append the sessions that are over to ``path``, and stop; returns the plays dropped as late."""
    writer = sessions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    run = writer.outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(state["numRowsDroppedByWatermark"] for p in run.recentProgress for state in p["stateOperators"])


def end_stream(
    spark: SparkSession, folder: str, last: datetime, gap_us: int = DEFAULTS.session_gap_us, delay: timedelta = timedelta(days=1)
) -> None:
    """A heartbeat that, in the next run, closes every session whose last play is not after ``last``; plays before it are late from then on."""
    write_heartbeat(spark, folder, last + timedelta(microseconds=gap_us) + delay + timedelta(seconds=1))
