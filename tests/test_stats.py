import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from playlytics.operators import graph, latent, stats, traits
from playlytics.sources import tables

PLAYS = "cluster int, g_id long, session long, ses_len long, year int, month int, prev_cluster int"


def centroids(spark, k):
    return spark.createDataFrame([(i, chr(65 + i), [float(i)]) for i in range(k)], "cluster int, cluster_label string, centroid array<double>")


def plays(spark, rows):
    return spark.createDataFrame(rows, PLAYS)


def test_cluster_stats_with_null_and_empty_cluster(spark):
    df = plays(
        spark,
        [
            (0, 1, 0, 3, 2024, 1, None),
            (0, 1, 0, 3, 2024, 1, 0),
            (0, 2, 1, 1, 2024, 2, None),
            (None, None, 0, 3, 2024, 1, 0),
        ],
    )
    got = {r.cluster: r for r in stats.cluster_stats(df, centroids(spark, 2)).collect()}
    assert set(got) == {0, 1, None}
    assert (got[0].n_plays, got[0].n_unique_plays, got[0].n_sessions, got[0].top_song_id, got[0].freq) == (3, 2, 2, 1, 0.75)
    assert (got[1].n_plays, got[1].freq, got[1].top_song_id, got[1].cluster_label) == (0, 0.0, None, "B")
    # the missing song counts as one
    assert (got[None].n_plays, got[None].n_unique_plays, got[None].cluster_label, got[None].centroid) == (1, 1, None, None)


def test_cluster_stats_per_month_has_every_cluster_every_month(spark):
    df = plays(spark, [(0, 1, 0, 2, 2024, 1, None), (1, 5, 0, 2, 2024, 2, 0)])
    got = stats.cluster_stats(df, centroids(spark, 3), per=("year", "month")).collect()
    assert sorted((r.month, r.cluster, r.n_plays, r.freq) for r in got) == [
        (1, 0, 1, 1.0), (1, 1, 0, 0.0), (1, 2, 0, 0.0), (2, 0, 0, 0.0), (2, 1, 1, 1.0), (2, 2, 0, 0.0),
    ]


def test_sessions_of_two_listeners_are_different(spark):
    df = plays(spark, [(0, 1, 0, 1, 2024, 1, None), (0, 1, 0, 1, 2024, 1, None)]).withColumn(
        "listener", F.monotonically_increasing_id()
    )
    assert stats.cluster_stats(df, centroids(spark, 1), by=("listener",)).first().n_sessions == 2
    assert stats.month_stats(df, by=("listener",)).first().n_sessions == 2


def test_mode_ties_and_null_mode(spark):
    rows = [(c, 1, 0, 4, 2024, 1, None) for c in (2, 1, 1, 2)] + [(c, 1, 0, 3, 2024, 2, None) for c in (None, None, 1)]
    got = {r.month: r for r in stats.month_stats(plays(spark, rows)).collect()}
    assert (got[1].cluster_mode, got[1].cluster_mode_count, got[1].cluster_mode_freq) == (1, 2, 0.5)
    assert (got[2].cluster_mode, got[2].cluster_mode_count) == (None, 0)
    ignoring = {r.month: r for r in stats.month_stats(plays(spark, rows), ignore_nulls=True).collect()}
    assert (ignoring[2].cluster_mode, ignoring[2].cluster_mode_count) == (1, 1)


def test_month_stats_counts_and_medians(spark):
    rows = [(0, 1, 0, 3, 2024, 1, None)] * 2 + [(0, 1, 0, 3, 2024, 2, None)] + [(0, 1, 1, 1, 2024, 2, None)] * 1 + [
        (0, 1, 2, 2, 2024, 2, None)
    ] * 2
    got = {r.month: r for r in stats.month_stats(plays(spark, rows)).collect()}
    assert (got[1].n_sessions, got[1].n_sessions_in_month, got[1].ses_len_median) == (1, 1, 3.0)
    # session numbers run on, and the session across the month's edge counts in both months
    assert (got[2].n_sessions, got[2].n_sessions_in_month, got[2].ses_len_max) == (3, 3, 3)
    assert (got[2].ses_len_median, got[2].ses_len_median_sessions) == (2.0, 2.0)


def test_diversity_bounds(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 0, 1, 2, 3]), 1, 0, 1, 2024, rng.randint(1, 6), None) for _ in range(200)]
    for r in stats.diversity(plays(spark, rows)).collect():
        assert 0 <= r.gini < 1 and 1 <= r.berger <= 5 and -1e-12 <= r.shannon <= math.log2(5) + 1e-12


def test_cluster_month_keeps_unclustered_plays_in_the_denominator(spark):
    rows = [(0, 1, 0, 1, 2024, 1, None)] + [(None, 1, 0, 1, 2024, 1, None)] * 3
    got = stats.cluster_month(plays(spark, rows), spark.createDataFrame([(0, "A"), (1, "B")], "cluster int, cluster_label string")).collect()
    assert [(r.cluster, r.cluster_label, r.n_cluster_plays, r.cluster_freq) for r in got] == [(0, "A", 1, 0.25)]


def test_hour_grid_is_full(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (None, 6)], "cluster int, hour int")
    got = {(r.hour, r.cluster): r["count"] for r in stats.hour_histogram(df, spark.createDataFrame([(0, "A"), (1, "B")], "cluster int, cluster_label string")).collect()}
    assert len(got) == 48 and got[(5, 0)] == 2 and sum(got.values()) == 2


def test_time_bins_in_order_of_day(spark):
    rows = [(2024, m, n, b) for m in (1, 2) for n, b in enumerate(("morning", "midday", "evening", "night"))]
    df = spark.createDataFrame(rows, "year int, month int, timebin_no int, timebin string")
    assert [r.timebin for r in stats.timebin_month(df).collect()][::2] == ["morning", "midday", "evening", "night"]


def test_edges_and_nodes(spark):
    rows = [
        (0, 1, 0, 3, 2024, 1, None),
        (1, 1, 0, 3, 2024, 2, 0),  # entered from cluster 0, not played in February
        (None, 1, 0, 3, 2024, 2, 1),
        (2, 1, 1, 1, 2024, 2, None),
    ]
    df = plays(spark, rows)
    edges = graph.graph_edges(df)
    assert [tuple(r) for r in edges.collect()] == [(0, 1, 1)]
    monthly = graph.graph_edges(df, ("year", "month"))
    nodes = graph.graph_nodes(df, spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "cluster int, cluster_label string"), ("year", "month"), monthly)
    assert sorted((r.month, r.name, r.weight) for r in nodes.collect()) == [(1, "A", 1), (2, "A", 0), (2, "B", 1), (2, "C", 1)]


def test_edge_weights_sum_to_adjacent_pairs(spark):
    rng = random.Random(3)
    rows, pairs = [], 0
    for session in range(20):
        length, before = rng.randint(1, 6), None
        for n in range(length):
            cluster = rng.choice([None, 0, 1, 2])
            rows.append((cluster, 1, session, length, 2024, 1, before))
            pairs += before is not None and cluster is not None
            before = cluster
    assert graph.graph_edges(plays(spark, rows)).agg(F.sum("weight")).first()[0] == pairs


def test_traits_weigh_plays_and_skip_missing_values(spark):
    df = plays(spark, [(0, 1, 0, 1, 2024, 1, None)] * 3 + [(0, 2, 0, 1, 2024, 1, None), (0, 9, 0, 1, 2024, 1, None)])
    raw = spark.createDataFrame([(1, 1.0, -1.0, 0.0, None, 2.0), (2, -3.0, -1.0, 0.0, 4.0, 2.0)], "id long, opn double, con double, ext double, agr double, neu double")
    monthly = traits.big5_by_month(df, tables.trait_outputs(raw))
    got = {r.trait_short: r for r in monthly.collect()}
    assert got["O"].logit == 0.0 and got["O"].trait_desc == "Open to experience"
    assert got["A"].logit == 4.0
    assert got["C"].trait_desc == "Messy" and got["C"].score == pytest.approx(math.tanh(-1))
    assert got["C"].score_pct == pytest.approx(100 * math.tanh(1))
    assert got["O"].date == datetime(2024, 1, 1).date()


def test_overall_trait_follows_the_sign_of_the_mean(spark):
    schema = "date date, trait string, trait_short string, trait_pos string, trait_neg string, score double"
    rows = [(datetime(2024, m, 1).date(), "Trait", "T", "yes", "no", s) for m, s in ((1, 0.1), (2, -0.5))]
    df = spark.createDataFrame(rows, schema)
    row = traits.big5_of_month(df).first()
    assert (row.trait_desc, row.score) == ("no", pytest.approx(-0.2))
    assert traits.big5_of_month(df, 2024, 2).first().score == -0.5
    assert traits.big5_of_month(df, 2030, 1).count() == 0


def test_latent_distance_weighs_repeated_steps(spark):
    steps = spark.createDataFrame(
        [(2024, 1, 1, 2)] * 3 + [(2024, 1, 1, 1), (2024, 1, None, 1), (2024, 1, 1, 9)], "year int, month int, prev_g_id long, g_id long"
    )
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, embedding array<double>")
    row = latent.latent_distance_month(steps, v).first()
    assert (row.latent_dist_mean, row.n_steps) == (3.75, 4)
