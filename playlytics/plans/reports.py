"""The data behind the three result pages, from the tables of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playlytics.config import DEFAULTS, Settings
from playlytics.functions.calendar import filter_month, month_list
from playlytics.operators import graph, search, songs, stats, traits


def monthly_report(
    tables: dict[str, DataFrame], year: int | None = None, month: int | None = None, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Everything shown for one month, or for the whole history when no month is chosen."""
    labels = tables["centroids"].select("cluster", "cluster_label")
    ses = filter_month(tables["sessions"], year, month)
    by = tuple(tables["layout"].first()["session_by"])  # a session is known by these columns and its number
    summary = stats.cluster_stats(ses, tables["centroids"], by)
    examples = songs.representative_songs(tables["song_clusters"], ses, tables["songs"], n=settings.n_representatives)
    covers = songs.cluster_covers(examples, tables["songs"])
    if year is None:
        nodes, edges = tables["graph_nodes"], tables["graph_edges"]
    else:
        edges = graph.graph_edges(ses)
        nodes = graph.graph_nodes(ses, labels, edges=edges)
    nodes, edges = graph.network(nodes, edges, covers)
    return {
        "months": month_list(tables["sessions"]),
        "cluster_stats": summary,
        "cluster_pie": stats.cluster_pie(summary),
        "representative_songs": examples.orderBy("cluster", "centroid_dist"),
        "graph_nodes": nodes,
        "graph_edges": edges,
        "big5": traits.big5_of_month(tables["big5"], year, month),
        "hour_histogram": stats.hour_histogram(filter_month(tables["plays_clustered"], year, month), labels).orderBy(
            "hour", "cluster"
        ),
    }


def timeline_report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "cluster_month": tables["cluster_month"].orderBy("date", "cluster"),
        "timebin_month": stats.timebin_month(tables["sessions"]),
        "diversity": tables["month_stats"].select("date", "gini", "shannon", "berger").orderBy("date"),
    }


def search_report(
    tables: dict[str, DataFrame], searches: DataFrame, n: int = DEFAULTS.n_search_results, **options
) -> DataFrame:
    """Result table for texts (search_num, search), with display column names."""
    hits = search.text_search(searches, tables["search_vectors"], n, **options)
    return songs.search_result_table(songs.song_metadata(hits, tables["songs"]))
