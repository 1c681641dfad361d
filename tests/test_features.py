from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlytics.functions import calendar, images, text, vectors
from playlytics.operators import matching
from playlytics.sources import tables


def local_plays(spark, *instants):
    return spark.createDataFrame([(datetime.fromisoformat(t),) for t in instants], "dt timestamp")


def test_time_bins_are_left_closed(spark):
    # US/Eastern is UTC-5 in January
    df = calendar.calendar_features(
        local_plays(
            spark,
            "2024-01-10T07:59:59",
            "2024-01-10T08:00:00",
            "2024-01-10T14:00:00",
            "2024-01-10T20:00:00",
            "2024-01-11T02:00:00",
        )
    ).orderBy("dt")
    assert [r.timebin for r in df.collect()] == ["night", "morning", "midday", "evening", "night"]


def test_calendar_uses_local_time_and_keeps_the_instant(spark):
    rows = calendar.calendar_features(local_plays(spark, "2024-11-03T05:30:00", "2024-11-03T06:30:00")).collect()
    assert {(r.hour, r.day, r.weekday, r.is_weekend) for r in rows} == {(1, 3, 6, True)}
    assert {r.dectime for r in rows} == {1.5}
    assert len({r.dt for r in rows}) == 2


def test_month_of_new_year_evening(spark):
    row = calendar.calendar_features(local_plays(spark, "2024-01-01T03:00:00.250000")).first()
    assert (row.year, row.month, row.day, row.time_us) == (2023, 12, 31, 22 * 3_600_000_000 + 250_000)


def test_month_list_from_newest_to_oldest(spark):
    df = spark.createDataFrame(
        [(datetime(2023, 11, 30), datetime(2023, 12, 1)), (datetime(2024, 1, 5), datetime(2024, 2, 1))],
        "ses_start timestamp, ses_end timestamp",
    )
    labels = [r.label for r in calendar.month_list(df).collect()]
    # the last session ends at midnight UTC, on January 31 local time
    assert labels == ["January 2024", "December 2023", "November 2023"]
    assert calendar.month_list(df.where("false")).count() == 0


def test_month_filter(spark):
    df = spark.createDataFrame([(2024, 1), (2024, 2), (2023, 1)], "year int, month int")
    assert calendar.filter_month(df, 2024, 1).count() == 1
    assert calendar.filter_month(df).count() == 3
    assert calendar.filter_month(df, 1999, 1).count() == 0


def test_uri_field(spark):
    df = spark.createDataFrame([("a:b:c",), ("a:b",), (None,), ("a:b:c:d",)], "u string")
    assert [r[0] for r in df.select(text.uri_field(F.col("u"))).collect()] == ["c", None, None, "c"]


def test_duplicate_match_key_doubles_plays_and_null_matches_keep_them(spark):
    t = datetime(2024, 1, 1)
    streams = spark.createDataFrame(
        [(t, "x:y:1", "s1", "al", "ar", "s", 1, 1), (t, "x:y", "s2", "al", "ar", "s", 2, 1)],
        "ts timestamp, track_uri string, track_name string, album_name string, artist_name string, source string, play_id long, listener long",
    )
    scrobbles = spark.createDataFrame(
        [(t, "s1", "ar", "al", "o", 1, 1)],
        "dt timestamp, song string, artist string, album string, source string, play_id long, listener long",
    )
    stream_matches = spark.createDataFrame([("1", 7), ("1", 8)], "id string, g_id long")
    scrobble_matches = spark.createDataFrame([("s1", "ar", 7), ("s1", "other", None)], "song string, artist string, g_id long")
    kept = tables.drop_null_matches(scrobble_matches)
    got = matching.match_plays(streams, scrobbles, stream_matches, kept).collect()
    assert sorted((r.source, r.play_id, r.g_id or -1) for r in got) == [("o", 1, 7), ("s", 1, 7), ("s", 1, 8), ("s", 2, -1)]
    assert tables.duplicate_keys(stream_matches, ["id"]).collect() == [("1", 2)]


def test_table_readers(spark):
    spark.range(3).selectExpr("id", "id AS _dlt_id", "id * 2 AS `two words`").createOrReplaceTempView("odd_table")
    assert tables.read_table(spark, "odd_table").columns == ["id", "two words"]
    assert tables.read_table(spark, '"odd_table"', ["two words"]).columns == ["two words"]
    assert tables.quote_name('a."b') == "`a`.`b`"
    query = "SELECT id FROM odd_table WHERE array_contains(:ids, id) AND id > :least"
    got = tables.run_query(spark, query, {"ids": F.array(F.lit(0), F.lit(2)), "least": 0})
    assert [r.id for r in got.collect()] == [2]


def test_vector_checks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<double>")
    assert tuple(tables.vector_check(df, 2).first()) == (1, 1, 1)
    with pytest.raises(Exception, match="not a vector of 2"):
        tables.fixed_width_vectors(df, 2).collect()
    assert tables.fixed_width_vectors(df.where("id = 1"), 2, "float").first().embedding == [1.0, 2.0]


def test_normalise(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<double>")
    rows = {r.id: r.embedding for r in vectors.normalise_rows(df).collect()}
    assert rows == {1: [0.6, 0.8], 2: [None, None]}
    one = vectors.normalise_columns(df.where("id = 1")).first().embedding
    assert one == [1.0, 1.0]
    zero = vectors.normalise_columns(spark.createDataFrame([(1, [0.0, -2.0])], df.schema)).first().embedding
    assert zero == [None, -1.0]


def test_distance_and_product(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<double>, b array<float>")
    row = df.select(vectors.l2_distance(F.col("a"), F.col("b")), vectors.inner_product(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (5.0, 16.0)


def test_prompt_and_names(spark):
    df = spark.createDataFrame([("a|b",)], "release_date string")
    assert df.select(text.search_prompt(F.col("release_date"))).first()[0] == "task: search result | query: ab"
    assert text.display_names(df).columns == ["Release Date"]


def test_embedding_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "x y z"), (2, "z  y\nx"), (3, ""), (4, "x " * 50_000 + "q")], "id int, text string")
    got = {r.id: r.embedding for r in text.embed_texts(df, width=16).collect()}
    assert got[1] == got[2]
    assert got[3] == [0.0] * 16
    assert sum(v * v for v in got[4]) == pytest.approx(1.0)
    assert sum(1 for v in got[4] if v) == 2  # the last word of a long text counts


def test_pluggable_embedder(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "a")], "id int, text string")
    lengths = lambda batch: np.array([[len(t), 0.0] for t in batch])
    got = {r.id: r.embedding for r in text.embed_texts(df, embedder=lengths).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0]}


def test_images(spark):
    default = "https://x/default_cover_image.png?1"
    rows = [("u", "v"), (default, "v"), (None, "v"), (default, default), (default, None), (None, None)]
    df = spark.createDataFrame(rows, "a string, h string")
    got = [r[0] for r in df.select(images.image_url(F.col("a"), F.col("h"))).collect()]
    assert got == ["u", "v", "v", None, None, None]


def test_image_from_json(spark):
    answers = [
        '{"track":{"album":{"image":[{"#text":"s"},{"#text":"l"}]}}}',
        '{"track":{"album":{"image":[]}}}',
        '{"track":{}}',
        '{"error":6}',
        None,
    ]
    df = spark.createDataFrame([(a,) for a in answers], "j string")
    assert [r[0] for r in df.select(images.image_from_json(F.col("j"))).collect()] == ["l", None, None, None, None]
