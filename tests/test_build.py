from playlytics.plans.build import Sources, build
from playlytics.plans.reports import monthly_report, search_report, timeline_report
from playlytics.sources.driver_tables import Inputs


def test_build_and_reports(spark, folder, tmp_path):
    i = Inputs(spark, folder)
    sources = Sources(
        i.streams(), i.scrobbles(), i.stream_matches(), i.scrobble_matches(), i.vectors(), i.vectors(), i.traits(), i.songs()
    )
    tables = build(spark, sources, str(tmp_path / "out"))
    n = i.streams().count() + i.scrobbles().count()
    for name in ("plays_expanded", "plays_clustered", "sessions"):
        assert tables[name].count() == n
    assert tables["song_clusters"].count() == i.vectors().count()
    assert tables["cluster_stats"].selectExpr("round(sum(freq), 9)").first()[0] == 1.0
    assert tables["graph_nodes"].selectExpr("sum(weight)").first()[0] == tables["sessions"].where("cluster is not null").count()

    january = monthly_report(tables, 2024, 1)
    plan = january["hour_histogram"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    whole = monthly_report(tables)
    for name, df in january.items():
        rows = df.count()
        assert rows > 0, name
        assert df.columns == whole[name].columns or name == "big5"
    assert january["hour_histogram"].count() == 24 * 7
    unplayed = monthly_report(tables, 1980, 1)
    assert unplayed["representative_songs"].count() == 0
    assert unplayed["cluster_stats"].selectExpr("sum(n_plays)").first()[0] == 0

    series = timeline_report(tables)
    assert series["diversity"].count() == tables["month_stats"].count()
    assert series["timebin_month"].selectExpr("sum(n)").first()[0] == n

    searches = spark.createDataFrame([(0, "some words to look for")], "search_num long, search string")
    assert search_report(tables, searches, 3).columns[0] == "Search"


def test_sessions_of_several_listeners(spark, folder, tmp_path):
    i = Inputs(spark, folder)
    sources = Sources(
        i.streams(), i.scrobbles(), i.stream_matches(), i.scrobble_matches(), i.vectors(), i.vectors(), i.traits(), i.songs()
    )
    tables = build(spark, sources, str(tmp_path / "out"), by=("listener",))
    got = {r["cluster"]: r["n_sessions"] for r in monthly_report(tables)["cluster_stats"].collect()}
    want = {}
    for r in tables["sessions"].select("cluster", "listener", "session").distinct().collect():
        want[r["cluster"]] = want.get(r["cluster"], 0) + 1
    assert {k: n for k, n in got.items() if n} == want
    assert len({r["listener"] for r in tables["sessions"].select("listener").distinct().collect()}) > 1


def test_intermediate_tables_are_deleted(spark, folder, tmp_path):
    import os

    from playlytics.sources import storage

    root = storage.scratch_root(spark)
    with storage.scratch_scope(spark):
        kept = storage.materialise(spark.range(5), "kept")
        assert kept.count() == 5
        (made,) = [p for p in os.listdir(root.removeprefix("file:")) if p.startswith("kept-")]
    assert made not in os.listdir(root.removeprefix("file:"))
