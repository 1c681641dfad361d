import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playlytics.functions.calendar import calendar_features
from playlytics.operators import graph, stats, traits
from playlytics.operators.sessions import order_within_sessions
from playlytics.plans.incremental import (
    TABLES,
    History,
    add_plays,
    read_big5,
    read_cluster_month,
    read_diversity,
    read_graph,
    read_month_stats,
    read_sessions,
    read_song_counts,
)
from playlytics.sources import storage

SCHEMA = "dt timestamp, source string, play_id long, listener long, g_id int, cluster int"
HOUR = 3_600_000_000


def plays(spark, n, seed, first=0):
    """Plays of a year: a third by one listener, some at the turn of a month, one session over several months."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        dt = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 200))
        if rng.random() < 0.2:
            dt = datetime(2024, rng.randint(2, 7), 1, 4) + timedelta(minutes=rng.randrange(-90, 90))
        g_id = rng.choice([None, *range(9)])
        rows.append((dt, rng.choice("os"), first + k, 0 if rng.random() < 0.33 else rng.choice([1, 2, None]), g_id, g_id and g_id % 3))
    rows += [(datetime(2024, 3, 1) + timedelta(hours=h), "x", first + h, 7, 1, 1) for h in range(0, 24 * 70, 2) if h % 3 == seed % 3]
    return calendar_features(spark.createDataFrame(rows, SCHEMA)).select(*SCHEMA.replace(",", "").split()[::2], "year", "month")


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    shown = lambda df: df.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])
    return sorted(map(str, shown(a).collect())) == sorted(map(str, shown(b).collect()))


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                found.setdefault(os.path.relpath(folder, path), set()).add(name)
    return found


def whole_is_right(spark, history, everything):
    whole = order_within_sessions(everything, history.gap_us, history.by)
    assert same(read_sessions(spark, history), whole)
    march = "year = 2024 and month = 3"
    assert same(read_sessions(spark, history, 2024, 3), whole.where(march))
    assert same(read_month_stats(spark, history), stats.month_stats(whole, history.by))
    labels = spark.createDataFrame([(k, chr(65 + k)) for k in range(3)], "cluster int, cluster_label string")
    trait_table = spark.createDataFrame([(k, [0.1 * k, -0.2, None, 0.3, 1.0 - k]) for k in range(7)], "id int, outputs array<double>")
    assert same(read_cluster_month(spark, history, labels), stats.cluster_month(whole, labels))
    assert same(read_diversity(spark, history), stats.diversity(whole))
    assert same(read_big5(spark, history, trait_table), traits.big5_by_month(whole, trait_table))
    for per in ((), ("year", "month")):
        nodes, edges = read_graph(spark, history, labels, per)
        want = graph.graph_edges(whole, per)
        assert same(edges, want) and same(nodes, graph.graph_nodes(whole, labels, per, want if per else None))
    counts = whole.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_plays"), F.expr("count(distinct g_id) + max(int(g_id is null))").alias("n_unique_plays"))
    assert same(read_song_counts(spark, history).drop("top_song_id"), counts)


@pytest.mark.parametrize("by", [(), ("listener",)])
@pytest.mark.parametrize("gap_us", [HOUR, 24 * HOUR])
def test_batches_equal_a_whole_build(spark, tmp_path, by, gap_us):
    history = History(str(tmp_path / "h"), by, gap_us)
    parts = [plays(spark, 200, k, 10_000 * k) for k in range(3)]
    everything = parts[0]
    assert add_plays(history, parts[0], "b0") == [(2023, 12), *[(2024, m) for m in range(1, 8)]]
    for k in (1, 2):
        add_plays(history, parts[k], f"b{k}")
        everything = everything.unionByName(parts[k])
    whole_is_right(spark, history, everything)


@pytest.mark.parametrize("by", [(), ("listener",)])
def test_late_plays_rewrite_their_months_only(spark, tmp_path, by):
    history = History(str(tmp_path / "h"), by, 24 * HOUR)
    first = plays(spark, 300, 0)
    add_plays(history, first, "first")
    before = {name: files(history.table(name)) for name in TABLES}
    # one play joins two sessions, one comes before all others of its month
    late = [(datetime(2024, 3, 20, 12), "s", 90_001, 0, 3, 0), (datetime(2024, 5, 1, 4, 0, 1), "s", 90_002, 1, 4, 1)]
    late = calendar_features(spark.createDataFrame(late, SCHEMA)).select(first.columns)
    assert add_plays(history, late, "late") == [(2024, 3), (2024, 5)]
    for name in TABLES:
        after = files(history.table(name))
        changed = {m for m in after if after[m] != before[name].get(m)}
        assert changed == {"year=2024/month=3", "year=2024/month=5"}, name
    whole_is_right(spark, history, first.unionByName(late))


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    history = History(str(tmp_path / "h"), ("listener",), HOUR)
    first, second = plays(spark, 100, 0), plays(spark, 100, 1, 10_000)
    add_plays(history, first, "first")
    add_plays(history, second, "second")
    add_plays(history, second, "second")
    whole_is_right(spark, history, first.unionByName(second))
    corrected = second.where("month > 5 or month < 3")
    add_plays(history, corrected, "second")
    whole_is_right(spark, history, first.unionByName(corrected))
    only = second.where("month = 2")
    other = History(str(tmp_path / "o"), (), HOUR)
    add_plays(other, only, "a")
    add_plays(other, second.where("month = 3"), "a")
    whole_is_right(spark, other, second.where("month = 3"))
    assert set(files(other.table("pieces"))) == {"year=2024/month=3"}


def test_no_plays_and_plays_without_a_time(spark, tmp_path):
    history = History(str(tmp_path / "h"))
    none = plays(spark, 0, 0).where("false")
    assert add_plays(history, none, "none") == []
    with pytest.raises(Exception, match="no time"):
        add_plays(history, plays(spark, 3, 0).withColumn("dt", F.lit(None).cast("timestamp")), "bad")


def test_an_update_reads_its_months_only(spark, tmp_path):
    history = History(str(tmp_path / "h"))
    add_plays(history, plays(spark, 100, 0), "a")
    plan = read_sessions(spark, history, 2024, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    plan = read_month_stats(spark, history)._jdf.queryExecution().executedPlan().toString()
    assert "pieces" not in plan


def test_the_plays_of_a_batch_are_written_once_and_joined_once(spark, tmp_path):
    names = []
    real = storage.materialise

    def noted(df, name, keep=False):
        names.append(name)
        return real(df, name, keep)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(storage, "materialise", noted)
        patch.setattr("playlytics.operators.sessions.materialise", noted)
        history = History(str(tmp_path / "h"), ("listener",))
        add_plays(history, plays(spark, 100, 0), "a")
        assert "batch" in names and "plays" not in names
        plan = read_sessions(spark, history)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 1
