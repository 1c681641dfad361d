import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playlytics.operators.sessions import order_within_sessions
from playlytics.streaming.sessions import end_stream, run_available, stream_sessions, with_heartbeats, write_heartbeat

SCHEMA = "dt timestamp, source string, play_id long, listener long"
START = datetime(2024, 1, 1)
HOUR = 3_600_000_000


class Stream:
    """A folder of plays that is read as a stream, file by file."""

    def __init__(self, spark, root, gap_us, by, delay_hours):
        self.spark, self.root, self.gap_us, self.by, self.hours = spark, str(root), gap_us, by, delay_hours
        write_heartbeat(spark, f"{self.root}/beats")

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/plays")

    def run(self):
        plays = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/plays")
        found = stream_sessions(with_heartbeats(plays, f"{self.root}/beats"), self.gap_us, self.by, f"{self.hours} hours")
        return run_available(found, f"{self.root}/out", f"{self.root}/check")

    def end(self, last):
        end_stream(self.spark, f"{self.root}/beats", last, self.gap_us, timedelta(hours=self.hours))
        return self.run()

    def result(self):
        return sorted(map(str, self.spark.read.parquet(f"{self.root}/out").collect()))


def batch(spark, rows, gap_us, by):
    ordered = order_within_sessions(spark.createDataFrame(rows, SCHEMA), gap_us, by, previous=())
    found = ordered.select(*by, "session", "ses_start", "ses_end", "ses_dur_us", "ses_len").distinct().drop("session")
    return sorted(map(str, found.collect()))


def plays(rng, n, first_hour, hours):
    pick = lambda: None if rng.random() < 0.1 else 0 if rng.random() < 0.4 else rng.randint(1, 3)
    # whole minutes, so that gaps of exactly an hour occur
    return [(START + timedelta(minutes=rng.randrange(60 * first_hour, 60 * (first_hour + hours))), "s", rng.random().__hash__() % 10**9, pick()) for _ in range(n)]


@pytest.mark.parametrize("by", [(), ("listener",)])
def test_stream_equals_batch(spark, tmp_path, by):
    rng = random.Random(3)
    stream = Stream(spark, tmp_path, HOUR, by, 6)
    rows = []
    for day in range(3):
        some = plays(rng, 40, 24 * day, 24)
        late = plays(rng, 10, max(0, 24 * day - 5), 5)  # within the delay: joins sessions that are still open
        rows += some + late
        stream.add(sorted(some))
        stream.add(late)
        assert stream.run() == 0
    open_ = len(batch(spark, rows, HOUR, by)) - len(stream.result())
    assert open_ > 0
    assert stream.end(max(r[0] for r in rows)) == 0
    assert stream.result() == batch(spark, rows, HOUR, by)


def test_plays_after_the_watermark_are_counted_and_dropped(spark, tmp_path):
    stream = Stream(spark, tmp_path, HOUR, ("listener",), 2)
    kept = [(START + timedelta(hours=h), "s", h, 1) for h in (0, 1, 30)]
    stream.add(kept)
    assert stream.run() == 0
    assert len(stream.result()) == 1
    stream.add([(START + timedelta(minutes=90), "s", 9, 1)])
    assert stream.run() == 1
    assert stream.end(START + timedelta(hours=30)) == 0
    assert stream.result() == batch(spark, kept, HOUR, ("listener",))


def test_gap_and_empty_runs(spark, tmp_path):
    exact = [(START, "s", 1, 1), (START + timedelta(hours=1), "s", 2, 1), (START + timedelta(hours=2, microseconds=1), "s", 3, 1)]
    frame = spark.createDataFrame([*exact, (None, "s", 4, 1)], SCHEMA)
    found = stream_sessions(frame, HOUR, ("listener",))
    assert [r["ses_len"] for r in found.orderBy("ses_start").collect()] == [2, 1]
    with pytest.raises(ValueError):
        stream_sessions(frame, 0)
    stream = Stream(spark, tmp_path, HOUR, (), 1)
    stream.add([])
    assert stream.run() == 0 and stream.result() == []
    stream.add(exact)
    stream.run()
    stream.end(START + timedelta(hours=3))
    before = stream.result()
    assert stream.run() == 0 and stream.result() == before and len(before) == 2


def test_state_holds_sessions_and_not_plays(spark, tmp_path):
    rows = [(START + timedelta(seconds=k), "s", k, k % 2) for k in range(2000)]
    write_heartbeat(spark, f"{tmp_path}/beats")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/plays")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/plays")
    found = stream_sessions(with_heartbeats(source, f"{tmp_path}/beats"), HOUR, ("listener",))
    run = found.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    assert found.isStreaming and F.col("x") is not None
