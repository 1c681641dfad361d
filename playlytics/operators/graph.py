"""Transitions between clusters inside sessions, as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_edges(sessions: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Number of direct steps from one cluster to another in sessions of more than one play."""
    steps = sessions.where(F.col("ses_len") > 1).dropna(subset=["prev_cluster", "cluster"])
    return steps.groupBy(*per, "prev_cluster", "cluster").agg(F.count(F.lit(1)).alias("weight"))


def graph_nodes(plays: DataFrame, labels: DataFrame, per: Sequence[str] = (), edges: DataFrame | None = None) -> DataFrame:
    """Plays per cluster. With ``edges``, a cluster that is only the end of an edge gets weight 0.

    A session that crosses a month's edge can enter the month from a cluster not played in it.
    """
    nodes = plays.dropna(subset=["cluster"]).groupBy(*per, "cluster").agg(F.count(F.lit(1)).alias("weight"))
    if edges is not None:
        ends = edges.select(*per, F.col("prev_cluster").alias("cluster"), F.lit(0).cast("bigint").alias("weight"))
        nodes = nodes.unionByName(ends).groupBy(*per, "cluster").agg(F.sum("weight").alias("weight"))
    return nodes.join(labels, "cluster", "left").select(*per, "cluster", F.col("cluster_label").alias("name"), "weight")


def network(nodes: DataFrame, edges: DataFrame, covers: DataFrame, per: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What a drawing needs: nodes with label, title, weight and image, and edges with weight."""
    keys = [*per, "cluster"]
    drawn = nodes.join(covers.select(*keys, "image"), keys, "left").select(
        *keys,
        F.col("name").alias("label"),
        F.format_string("Cluster %s", "name").alias("title"),
        F.coalesce("image", F.lit("")).alias("image"),
        "weight",
    )
    return drawn, edges
