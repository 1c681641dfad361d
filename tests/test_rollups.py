import random

import pytest
from pyspark.sql import functions as F

from playlytics.operators import rollups


def plays(spark, n=3000, seed=1):
    rng = random.Random(seed)
    edge = [0, 32767, 32768, 65535, 65536, 2**31 - 1, 2**40, -1, -32768, -40000]
    # a third of the rows is in one group
    pick = lambda: rng.choice([None, *edge, *range(50)])
    rows = [(2024, 1 if rng.random() < 0.33 else rng.randint(2, 5), rng.choice([None, 0, 1]), pick(), rng.randrange(40)) for _ in range(n)]
    return spark.createDataFrame(rows, "year int, month int, cluster int, g_id long, session long"), rows


@pytest.mark.parametrize("per", [("year", "month", "cluster"), ("month",), ("cluster",), ()])
def test_distinct_counts_roll_up(spark, per):
    df, rows = plays(spark)
    fine = rollups.distinct_bitmaps(df.repartition(7), ["g_id", "session"], ["year", "month", "cluster"])
    merged = rollups.merge_bitmaps(fine, per)
    got = {tuple(r[c] for c in per): (r["n_g_id"], r["n_session"]) for r in rollups.count_distinct(merged, ["g_id", "session"], per).collect()}
    place = {"year": 0, "month": 1, "cluster": 2}
    want = {}
    for r in rows:
        songs, sessions = want.setdefault(tuple(r[place[c]] for c in per), (set(), set()))
        songs.add(r[3])
        sessions.add(r[4])
    assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}


def test_distinct_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "month int, g_id int")
    found = rollups.count_distinct(rollups.distinct_bitmaps(df, ["g_id"], ["month"]), ["g_id"], ["month"])
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    none = rollups.distinct_bitmaps(df.where("month = 2"), ["g_id"], ["month"])
    assert rollups.count_distinct(none, ["g_id"], ["month"]).collect() == []
    assert rollups.count_distinct(none, ["g_id"], []).first()[0] == 0


def test_one_pass_for_all_keys(spark):
    df, _ = plays(spark, 10)
    plan = rollups.distinct_bitmaps(df, ["g_id", "session"], ["month"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_medians_of_merged_sketches(spark):
    rng = random.Random(4)
    rows = [(m, rng.randrange(500), int(rng.paretovariate(1.1))) for m in (1, 2, 3) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "month int, listener int, ses_len long")
    fine = rollups.sketches(df, "ses_len", ["month", "listener"])
    found = rollups.merge_sketches(fine, ["month"]).select("month", rollups.quantile().alias("guess"))
    counts = df.groupBy("month", "ses_len").agg(F.count(F.lit(1)).alias("n"))
    errors = rollups.rank_error(counts, found, "ses_len", "guess", ["month"]).collect()
    assert len(errors) == 3 and all(r["error"] <= rollups.RANK_BOUND for r in errors)
    assert 3 * rollups.rank_bound(rollups.SKETCH_SIZE) < rollups.RANK_BOUND
    whole = rollups.merge_sketches(fine, []).select(rollups.quantile().alias("guess"))
    (all_,) = rollups.rank_error(counts.groupBy("ses_len").agg(F.sum("n").alias("n")), whole, "ses_len", "guess", []).collect()
    assert all_["error"] <= rollups.RANK_BOUND


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([(1, x) for x in (5, 1, 9, 7, 3)] + [(2, None)], "month int, v int")
    found = rollups.sketches(df, "v", ["month"]).select("month", rollups.quantile().alias("m"), "n").orderBy("month").collect()
    assert [tuple(r) for r in found] == [(1, 5, 5), (2, None, 0)]


def test_rank_error(spark):
    counts = spark.createDataFrame([(1, 10), (2, 80), (3, 10)], "v int, n long")
    for guess, want in ((1, 0.4), (2, 0.0), (3, 0.4), (9, 0.5)):
        one = spark.createDataFrame([(guess,)], "guess int")
        assert rollups.rank_error(counts, one, "v", "guess", []).first()["error"] == pytest.approx(want)
