import os
import shutil

import pytest
from pyspark.sql import functions as F

from playlytics.functions.calendar import filter_months, month_dimension
from playlytics.operators import clustering, search
from playlytics.sources import storage
from playlytics.sources.results import Results


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def results(spark, tmp_path):
    clock = Clock()
    found = Results(spark, str(tmp_path / "results"), 60, clock)
    made = []

    def compute(value):
        def run():
            made.append(value)
            return spark.createDataFrame([(value,)], "v int")

        return run

    return found, clock, compute, made


def value(df):
    return df.first()["v"]


def test_results_are_read_until_they_are_too_old(results):
    found, clock, compute, made = results
    assert value(found.get("a", compute(1))) == 1
    clock.now += 60
    assert value(found.get("a", compute(2))) == 1 and made == [1]
    clock.now += 1
    assert value(found.get("a", compute(3))) == 3 and made == [1, 3]
    assert value(found.get("b/with spaces", compute(4))) == 4


def test_lost_files_are_made_again(results):
    found, clock, compute, made = results
    found.get("a", compute(1))
    shutil.rmtree(found.entry("a")["path"])
    assert value(found.get("a", compute(2))) == 2
    # a failed computation leaves the result as it was
    clock.now += 100
    with pytest.raises(ZeroDivisionError):
        found.get("a", lambda: 1 / 0)
    assert found.entry("a")["written"] == 1000


def test_old_folders_go(results):
    found, clock, compute, made = results
    paths = []
    opened = None
    for k in range(3):
        before, opened = opened, found.get("a", compute(k))
        paths.append(found.entry("a")["path"])
        if before is not None:
            assert value(before) == k - 1  # whoever read the result before can go on
        clock.now += 61
    assert [os.path.exists(p) for p in paths] == [False, True, True]
    found.get("b", compute(9))
    os.mkdir(f"{found.path}/data/left-by-a-failed-run")
    assert found.sweep() == ["a"]
    assert os.listdir(f"{found.path}/data") == [os.path.basename(found.entry("b")["path"])]
    found.forget("b")
    found.forget("never")
    assert found.entry("b") is None and os.listdir(f"{found.path}/data") == []


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_bucketed_tables_do_not_move_them(spark, tmp_path):
    left = spark.range(1000).selectExpr("id", "id * 2 as x")
    right = spark.range(500, 1500).selectExpr("id", "id * 3 as y")
    a = storage.write_bucketed(left, str(tmp_path / "a"), "id", 8)
    storage.write_bucketed(right, str(tmp_path / "b"), "id", 8)
    spark.sql(f"DROP TABLE {storage._table_name(str(tmp_path / 'b'))}")  # as in a new session
    b = storage.open_bucketed(spark, str(tmp_path / "b"))
    assert len([f for f in os.listdir(tmp_path / "b") if f.endswith(".parquet")]) == 8
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "id")
        assert "Exchange" not in plan_of(joined) and joined.count() == 500
        few = spark.createDataFrame([(700,), (700,), (5000,)], "id long")
        looked_up = b.join(few, "id")
        plan = plan_of(looked_up)
        assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and looked_up.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_months_are_pruned_when_the_query_runs(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id", "cast(2020 + id % 2 as int) as year", "cast(1 + id % 12 as int) as month")
    storage.write_by_month(rows, str(tmp_path / "plays"))
    plays = spark.read.parquet(str(tmp_path / "plays"))
    storage.write_table(month_dimension(plays), str(tmp_path / "months"))
    months = spark.read.parquet(str(tmp_path / "months"))
    found = filter_months(plays, months.where("label = 'March 2020'"))
    plan = plan_of(found)
    assert "dynamicpruning" in plan
    assert sorted(r["id"] for r in found.collect()) == [i for i in range(1200) if i % 2 == 0 and i % 12 == 2]
    assert filter_months(plays, months.where("false")).count() == 0


def test_search_without_a_python_worker(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [float("nan"), 1.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, -1.0]), (2, [0.6, 0.8])], "search_num long, embedding array<double>")
    own = lambda **options: sorted(map(tuple, search.vector_search(vectors, queries, 3, **options).collect()))
    found = search.vector_search(vectors, queries, 3, candidates=search.score_all)
    plan = plan_of(found)
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and plan.count("WindowGroupLimit") >= 2
    assert own(candidates=search.score_all) == own() == own(candidates=search.score_all, broadcast_bytes=16)


def test_costs_do_not_rise_with_k(spark):
    vectors = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)]).alias("embedding"))
    rows = clustering.compare_sizes(vectors, [6, 2, 4, 4, 3]).collect()
    assert [r["k"] for r in rows] == [2, 3, 4, 6]
    costs = [r["cost"] for r in rows]
    assert costs == sorted(costs, reverse=True) and all(-1 <= r["silhouette"] <= 1 for r in rows)
    same = spark.range(5).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    (one,) = clustering.compare_sizes(same, [3]).collect()
    assert one["n_clusters"] == 1 and one["silhouette"] is None and one["cost"] == 0


def test_scopes_of_threads_are_apart(spark):
    import threading

    made, inside, done = [], threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        made.append(storage.scratch_path(spark, "other"))
        spark.range(3).write.parquet(made[0])
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with storage.scratch_scope(spark):
        own = storage.scratch_path(spark, "own")
        spark.range(3).write.parquet(own)
        inside.set()
        done.wait(60)
    thread.join()
    assert not storage.exists(spark, own) and spark.read.parquet(made[0]).count() == 3
