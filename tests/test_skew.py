"""Plans under a key that holds a third of the rows."""

import pytest
from pyspark.sql import functions as F

from playlytics.operators import matching, sessions, songs
from playlytics.sources import storage

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_plays(spark, n=40_000):
    hot = F.col("id") % 3 == 0
    plays = spark.range(0, n, 1, 8).select(
        F.timestamp_seconds(1_700_006_400 + F.col("id")).alias("dt"),
        F.when(hot, 0).otherwise(F.col("id") % 500).alias("g_id"),
        F.when(hot, 0).otherwise(F.col("id") % 500).alias("listener"),
        F.md5(F.col("id").cast("string")).alias("song"),
        F.lit("s").alias("source"),
        F.col("id").alias("play_id"),
    )
    return storage.materialise(plays, "hot")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_song_is_split_in_the_cluster_join(spark, no_broadcast):
    plays = hot_plays(spark)
    clusters = storage.materialise(spark.range(500).select(F.col("id").alias("g_id"), (F.col("id") % 7).alias("cluster")), "c")
    joined = matching.cluster_plays(plays, clusters)
    assert "skew=true" in final_plan(joined)
    # also when an aggregate on the same key follows
    counted = joined.groupBy("g_id").agg(F.count("cluster").alias("n"), F.max("song"))
    assert "skew=true" in final_plan(counted)
    assert counted.agg(F.sum("n")).first()[0] == 40_000


def test_hot_listener_is_split_when_sessions_are_attached(spark, no_broadcast):
    plays = hot_plays(spark)
    # one cell of a day holds a third of all plays
    assigned = sessions.assign_sessions(plays, by=("listener",))
    assert "skew=true" in final_plan(assigned)
    assert assigned.count() == 40_000 and assigned.where("session is null").count() == 0


def test_closest_songs_are_limited_before_the_shuffle(spark):
    distances = spark.range(1000).select(
        F.col("id").alias("g_id"), (F.col("id") % 2).alias("cluster"), F.lit("A").alias("cluster_label"), F.rand(1).alias("centroid_dist")
    )
    assert "WindowGroupLimit" in songs.distance_limits(distances, 3)._jdf.queryExecution().executedPlan().toString()


def test_month_tables_are_rebalanced(spark, tmp_path):
    plays = hot_plays(spark, 3000).withColumns({"year": F.year("dt"), "month": F.month("dt")})
    plan = plays.hint("rebalance", "year", "month")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    storage.write_by_month(plays, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3000
