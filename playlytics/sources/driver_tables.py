"""The listening-domain inputs, derived from the generic test tables (see FIXTURES.md §3)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playlytics.config import DEFAULT_COVER, configure
from playlytics.sources.storage import materialise

_schemas: dict[str, StructType] = {}


class Inputs:
    """Lazily read inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in _schemas:  # reading the footer is a job of its own
            _schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path]).parquet(path)

    def streams(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return (
            self.read("events")
            .withColumn("k", k)
            .select(
                F.col("ts").cast("timestamp").alias("ts"),
                F.concat(F.lit("app:track:"), "k").alias("track_uri"),
                F.concat(F.lit("song "), "k").alias("track_name"),
                F.col("event_type").alias("album_name"),
                F.expr("concat('artist ', k div 10)").alias("artist_name"),
                F.lit("s").alias("source"),
                F.col("event_id").alias("play_id"),
                F.col("user_id").alias("listener"),
            )
        )

    def scrobbles(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderdate").cast("timestamp").alias("dt"),
            F.expr("concat('song ', o_custkey div 4)").alias("song"),
            F.expr("concat('artist ', o_custkey div 40)").alias("artist"),
            F.col("o_orderpriority").alias("album"),
            F.lit("o").alias("source"),
            F.col("o_orderkey").alias("play_id"),
            F.col("o_custkey").alias("listener"),
        )

    @cached_property
    def _matches(self) -> DataFrame:
        """Written once, as the match tables of a real history are stored tables."""
        rejected = (F.col("quality") == 0) | (F.col("toxic") == 1)
        docs = self.read("documents").select("doc_id").join(self.read("labels"), "doc_id", "left")
        matched = F.when(F.coalesce(rejected, F.lit(False)), None).otherwise(F.col("doc_id"))
        return materialise(docs.select("doc_id", matched.alias("g_id")), "matches")

    def stream_matches(self) -> DataFrame:
        return self._matches.select(F.col("doc_id").cast("string").alias("id"), "g_id")

    def scrobble_matches(self) -> DataFrame:
        return self._matches.select(
            F.expr("concat('song ', doc_id)").alias("song"),
            F.expr("concat('artist ', doc_id div 10)").alias("artist"),
            "g_id",
        )

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    def song_clusters(self) -> DataFrame:
        """The injected assignment: the label of a vector is its cluster."""
        return self.read("embeddings").select(F.col("vec_id").alias("g_id"), F.col("label").alias("cluster"))

    def traits(self) -> DataFrame:
        value = lambda i: (F.col("embedding")[i].cast("double") * 4)
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"),
            *[value(i).alias(name) for i, name in enumerate(("opn", "con", "ext", "agr", "neu"))],
        )

    def songs(self) -> DataFrame:
        cover = F.concat(F.lit("https://img.example.com/"), F.lit(DEFAULT_COVER), F.lit(".png"))
        return (
            self.read("documents")
            .join(self.read("pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
            .join(self.read("labels"), "doc_id", "left")
            .select(
                F.col("doc_id").alias("id"),
                F.expr("concat('song ', doc_id)").alias("title"),
                F.col("source").alias("artist_names"),
                F.col("lang").alias("album_name"),
                F.col("n_chars").cast("string").alias("release_date"),
                "url",
                F.when(F.col("quality") == 1, F.col("url")).otherwise(cover).alias("art_url"),
                F.when(F.col("lang") == "en", cover).otherwise(F.col("url")).alias("header_url"),
            )
        )


class StreamInputs(Inputs):
    """The same inputs, with the plays read as streams of files; the match tables stay tables."""

    def read(self, name: str) -> DataFrame:
        if name not in ("events", "orders"):
            return super().read(name)
        # a pattern, as a stream's plain path must be a folder and a table may be one file
        return self.spark.readStream.schema(super().read(name).schema).parquet(f"{self.folder}/{name}.parque[t]")
