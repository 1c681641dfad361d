import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from playlytics.operators import sessions
from playlytics.operators.sessions import assign_sessions, order_within_sessions, session_cells

SCHEMA = "dt timestamp, source string, play_id long, listener long, cluster int"
START = datetime(2024, 1, 30)
DAY = timedelta(days=1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def timed(spark, rows):
    us = F.unix_micros("dt")
    return frame(spark, rows).withColumns({"first_us": us, "last_us": us, "n": F.lit(1).cast("bigint")})


def plain(df, gap_us, by):
    """The textbook window over whole histories."""
    order = Window.partitionBy(*by).orderBy("dt", "source", "play_id")
    us = F.unix_micros("dt")
    numbered = df.withColumn("timediff_us", us - F.lag(us).over(order)).withColumn(
        "session",
        F.sum(F.coalesce((F.col("timediff_us") > gap_us).cast("long"), F.lit(0))).over(
            order.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    inside = Window.partitionBy(*by, "session").orderBy("dt", "source", "play_id")
    whole = Window.partitionBy(*by, "session")
    return numbered.withColumns(
        {
            "prev_cluster": F.lag("cluster").over(inside),
            "n_within_ses": F.row_number().over(inside) - 1,
            "ses_start": F.min("dt").over(whole),
            "ses_end": F.max("dt").over(whole),
            "ses_len": F.count(F.lit(1)).over(whole),
        }
    )


COLUMNS = [
    "source", "play_id", "listener", "session", "timediff_us", "prev_cluster", "n_within_ses", "ses_start", "ses_end", "ses_len",
]


def as_set(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("by", [(), ("listener",)])
@pytest.mark.parametrize("gap_us,chunks", [(1, 3), (60_000_000, 7), (3_600_000_000, 2), (86_400_000_000, 5)])
def test_equals_plain_window(spark, by, gap_us, chunks):
    rng = random.Random(gap_us + chunks)
    rows = []
    for n in range(600):
        # a third of all plays belongs to listener 0, a third falls on one instant
        when = START if rng.random() < 0.33 else START + timedelta(microseconds=int(rng.expovariate(1 / (gap_us * 40))))
        listener = 0 if rng.random() < 0.33 else rng.choice([1, 2, 3, None])
        rows.append((when, rng.choice("os"), n, listener, rng.choice([0, 1, 2, None])))
    df = frame(spark, rows)
    assert as_set(order_within_sessions(df, gap_us, by, chunks=chunks)) == as_set(plain(df, gap_us, by))


@pytest.mark.parametrize("by", [(), ("listener",)])
@pytest.mark.parametrize("chunks", [None, 6])
def test_assignment_without_order_equals_the_ordered_one(spark, by, chunks):
    rng = random.Random(7)
    rows = [
        (START + timedelta(minutes=int(rng.expovariate(1 / 9000))), "s", n, rng.choice([0, 0, 1, None]), 0) for n in range(300)
    ]
    df = frame(spark, rows)
    columns = ["play_id", "session", "ses_start", "ses_end", "ses_dur_us", "ses_len"]
    got = assign_sessions(df, 3_600_000_000, by, chunks=chunks).select(*columns)
    want = order_within_sessions(df, 3_600_000_000, by, chunks=3).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_boundary_is_strict(spark):
    rows = [
        (START, "s", 1, 1, 0),
        (START + DAY, "s", 2, 1, 0),
        (START + 2 * DAY + timedelta(microseconds=1), "s", 3, 1, 0),
    ]
    got = order_within_sessions(frame(spark, rows)).orderBy("dt").collect()
    assert [r.session for r in got] == [0, 0, 1]
    assert [r.ses_len for r in got] == [2, 2, 1]
    assert [r.n_within_ses for r in got] == [0, 1, 0]
    assert [r.timediff_us for r in got] == [None, 86_400_000_000, 86_400_000_001]
    assert got[0].ses_dur_us == 86_400_000_000


def test_plays_before_1970(spark):
    rows = [(datetime(1969, 12, 31, 12) + n * timedelta(hours=20), "s", n, 1, 0) for n in range(4)]
    got = assign_sessions(frame(spark, rows)).collect()
    assert {r.session for r in got} == {0}


def test_null_cluster_blocks_the_step(spark):
    hour = timedelta(hours=1)
    rows = [(START, "s", 1, 1, 0), (START + hour, "s", 2, 1, None), (START + 2 * hour, "s", 3, 1, 1)]
    got = order_within_sessions(frame(spark, rows)).orderBy("dt").collect()
    assert [r.prev_cluster for r in got] == [None, 0, None]


def test_cells_hold_no_more_rows_than_elapsed_gaps(spark):
    rows = [(START + timedelta(minutes=n), "s", n, n % 2, 0) for n in range(3000)]
    assert session_cells(frame(spark, rows)).count() <= 3


@pytest.mark.parametrize("by", [(), ("listener",)])
def test_no_pass_over_plays_in_one_task(spark, by):
    rows = [(START + timedelta(minutes=n), "s", n, 1, 0) for n in range(50)]
    chunked = sessions._number_chunks(timed(spark, rows), 1, by, ("cluster",), 4, ("first_us", "source", "play_id"))
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "rangepartitioning" in plan
    plan = order_within_sessions(frame(spark, rows), by=by)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_corrections_are_bounded_by_chunks(spark):
    rows = [(START + timedelta(minutes=n), "s", n, 0 if n % 3 else n, 0) for n in range(900)]
    chunked = sessions._number_chunks(timed(spark, rows), 10**9, ("listener",), (), 8, ("first_us", "source", "play_id"))
    written = sessions.materialise(chunked, "chunks")
    sizes = [r["count"] for r in written.groupBy("chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 300  # the hot listener has 600 plays
    assert sessions._split_histories(written, 10**9, ("listener",), ()).count() <= 16


def test_doubled_match_key_does_not_depend_on_the_input_order(spark):
    """A doubled match key gives two rows of one play, which differ in song and cluster."""
    rows = [(START + timedelta(hours=h), "s", h, 1, c, g) for h in range(40) for c, g in ((h % 3, 2 * h), (None if h % 2 else 4, 2 * h + 1))]
    results = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA + ", g_id long").repartition(seed + 1)
        found = order_within_sessions(df, chunks=5)
        results.append(sorted(map(str, found.select("g_id", "session", "n_within_ses", "timediff_us", "prev_cluster").collect())))
    assert results[0] == results[1] == results[2]


def test_chunks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sessions, "CHUNK_ROWS", 100)
    rows = [(START + timedelta(minutes=n), "s", n, 0, 0) for n in range(950)]
    df = frame(spark, rows)
    assert as_set(order_within_sessions(df, 10**9)) == as_set(plain(df, 10**9, ()))


def test_invalid_gap(spark):
    with pytest.raises(ValueError):
        session_cells(frame(spark, []), 0)


def test_empty_history(spark):
    df = order_within_sessions(frame(spark, []))
    assert df.count() == 0 and "prev_cluster" in df.columns


def test_chunks_are_bounded(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(START + timedelta(minutes=rng.randrange(9000)), "s", n, rng.choice([0, 0, 1, None]), n % 3) for n in range(300)]
    df = frame(spark, rows)
    want = as_set(plain(df, 3_600_000_000, ("listener",)))
    assert as_set(order_within_sessions(df, 3_600_000_000, ("listener",))) == want
    used = []
    cut = sessions._number_chunks
    monkeypatch.setattr(sessions, "_number_chunks", lambda *a: used.append(a[4]) or cut(*a))
    monkeypatch.setattr(sessions, "CHUNK_ROWS", 10)
    assert as_set(order_within_sessions(df, 3_600_000_000, ("listener",))) == want
    monkeypatch.setattr(sessions, "MAX_CHUNKS", 7)
    assert as_set(order_within_sessions(df, 3_600_000_000, ("listener",))) == want
    assert used == [30, 7]
