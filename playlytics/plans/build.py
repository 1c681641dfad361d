"""The batch build: every derived table is written once and later steps read what was written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from playlytics.config import DEFAULTS, Settings, configure
from playlytics.functions.calendar import calendar_features
from playlytics.operators import clustering, graph, matching, sessions, stats, traits
from playlytics.operators.search import search_table
from playlytics.sources import storage, tables

EXPANDED = (
    "dt", "g_id", "song", "album", "artist", "source", "play_id", "listener", "year", "month", "day", "weekday",
    "time_us", "hour", "is_weekend", "dectime", "timebin_no", "timebin",
)
SESSION = (
    "session", "ses_start", "ses_end", "ses_dur_us", "ses_len", "n_within_ses", "dt", "timebin_no", "timebin", "hour",
    "year", "month", "timediff_us", "cluster", "prev_cluster", "cluster_label", "g_id", "song", "artist", "album",
    "source", "play_id", "listener",
)


@dataclass
class Sources:
    """The input tables, see FIXTURES.md §1."""

    streams: DataFrame
    scrobbles: DataFrame
    stream_matches: DataFrame
    scrobble_matches: DataFrame
    cluster_vectors: DataFrame
    search_vectors: DataFrame
    traits: DataFrame
    songs: DataFrame


def build(
    spark: SparkSession, sources: Sources, out: str, settings: Settings = DEFAULTS, by: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """Write all tables below ``out`` and return them as read back; intermediate tables are deleted.

    ``by`` names the columns whose values each have a session numbering of their own.
    """
    configure(spark)
    with storage.scratch_scope(spark):
        _write_tables(spark, sources, out, settings, by)
    return open_tables(spark, out)


def _write_tables(spark: SparkSession, sources: Sources, out: str, settings: Settings, by: tuple[str, ...]) -> None:
    read = lambda name: spark.read.parquet(f"{out}/{name}")

    width = tables.vector_width(sources.search_vectors)
    storage.write_table(search_table(sources.search_vectors, width), f"{out}/search_vectors")
    vectors = tables.fixed_width_vectors(
        sources.cluster_vectors.select("id", "embedding"), tables.vector_width(sources.cluster_vectors)
    )
    storage.write_table(vectors, f"{out}/cluster_vectors")
    vectors = read("cluster_vectors")

    model = clustering.fit_clusterer(vectors, settings.n_clusters, settings.seed)
    storage.save_clusterer(model, f"{out}/clusterer")
    order = clustering.cluster_order(vectors, model)
    storage.write_table(clustering.model_centroids(vectors, model, order), f"{out}/centroids")
    centroids = read("centroids")
    labels = centroids.select("cluster", "cluster_label")
    assigned = clustering.assign_clusters(vectors, model, order)
    storage.write_table(clustering.centroid_distances(assigned, centroids), f"{out}/song_clusters")
    song_clusters = read("song_clusters")

    matched = matching.match_plays(
        sources.streams, sources.scrobbles, sources.stream_matches, tables.drop_null_matches(sources.scrobble_matches)
    )
    storage.write_by_month(calendar_features(matched, settings).select(*EXPANDED), f"{out}/plays_expanded")
    clustered = matching.cluster_plays(read("plays_expanded"), song_clusters)

    ordered = sessions.order_within_sessions(clustered, settings.session_gap_us, by)
    storage.write_by_month(ordered.select(*EXPANDED, "cluster", "timediff_us"), f"{out}/plays_clustered")
    labelled = ordered.join(labels, "cluster", "left")
    storage.write_by_month(labelled.select(*SESSION), f"{out}/sessions")
    ses = read("sessions")

    storage.write_table(stats.cluster_stats(ses, centroids, by), f"{out}/cluster_stats")
    storage.write_table(stats.month_stats(ses, by), f"{out}/month_stats")
    storage.write_table(stats.cluster_month(read("plays_clustered"), labels), f"{out}/cluster_month")
    storage.save_graph(graph.graph_nodes(ses, labels), graph.graph_edges(ses), f"{out}/graph")
    trait_table = tables.trait_outputs(sources.traits)
    storage.write_table(traits.big5_by_month(ses, trait_table), f"{out}/big5")
    storage.write_table(sources.songs, f"{out}/songs")
    storage.write_table(spark.createDataFrame([(list(by),)], "session_by array<string>"), f"{out}/layout")


TABLES = (
    "search_vectors", "cluster_vectors", "centroids", "song_clusters", "plays_expanded", "plays_clustered", "sessions",
    "cluster_stats", "month_stats", "cluster_month", "big5", "songs", "layout",
)


def open_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    found = {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}
    found["graph_nodes"], found["graph_edges"] = storage.load_graph(spark, f"{out}/graph")
    return found
