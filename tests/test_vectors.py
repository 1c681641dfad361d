import numpy as np
import pytest

from playlytics.operators import clustering, search, songs
from playlytics.sources import storage


def vectors(spark, matrix, first=0):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def brute_force(corpus, queries, n):
    scores = np.round(queries @ corpus.T, 12)
    return [
        (q, rank, int(i), float(scores[q, i]))
        for q in range(len(queries))
        for rank, i in enumerate(np.lexsort((np.arange(len(corpus)), -scores[q]))[:n])
    ]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 1])
def test_search_is_exact_with_many_copies(spark, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(90, 6))
    corpus[::3] = corpus[0]  # a third of the rows are copies
    queries = rng.normal(size=(7, 6))
    queries[0] = corpus[0]
    asked = vectors(spark, queries).withColumnRenamed("id", "search_num")
    got = search.vector_search(vectors(spark, corpus).repartition(5), asked, 4, broadcast_bytes=broadcast_bytes)
    assert [tuple(r) for r in got.orderBy("search_num", "rank").collect()] == brute_force(corpus, queries, 4)


def test_search_with_fewer_vectors_than_asked_and_bounds(spark):
    corpus = vectors(spark, [[1.0, 0.0], [0.5, 0.0], [-1.0, 0.0]])
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "search_num long, embedding array<double>")
    assert search.vector_search(corpus, asked, 10).count() == 3
    bounded = search.vector_search(corpus, asked, 2, min_dist=0.6)
    assert [(r["rank"], r["id"]) for r in bounded.collect()] == [(0, 0)]
    assert search.vector_search(corpus, asked, 2, max_dist=0.6).first()["rank"] == 1
    none = search.vector_search(corpus, asked.where("false"))
    assert none.count() == 0 and none.columns == ["search_num", "rank", "id", "dist"]


def test_text_search_and_metadata(spark):
    from playlytics.functions.text import embed_texts

    lyrics = spark.createDataFrame([(1, "task search result query red"), (2, "blue green sea"), (3, "x y z")], "id long, text string")
    table = embed_texts(lyrics, width=64).select("id", "embedding")
    searches = spark.createDataFrame([(0, "red"), (1, "blue sea|")], "search_num long, search string")
    hits = search.text_search(searches, table, 2)
    assert hits.where("rank = 0 AND search_num = 0").first()["id"] == 1
    meta = spark.createDataFrame(
        [(1, "One", "A", "B", "2020", "u1"), (2, "Two", "A", "B", "2021", "u2")],
        "id long, title string, artist_names string, album_name string, release_date string, url string",
    )
    table = songs.search_result_table(songs.song_metadata(hits, meta))
    assert table.columns == ["Search", "Rank", "Song", "Artist", "Album", "Release Date", "Url"]
    empty = songs.song_metadata(hits.where("false"), meta)
    assert empty.count() == 0 and "release_date" in empty.columns


def test_clusterer(spark, tmp_path):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.1, size=(n, 2)) for c, n in ((0, 10), (5, 30), (9, 20))])
    df = vectors(spark, points)
    model = clustering.fit_clusterer(df, 3)
    order = clustering.cluster_order(df, model)
    assigned = clustering.assign_clusters(df, model, order)
    assert [r["count"] for r in assigned.groupBy("cluster").count().orderBy("cluster").collect()] == [30, 20, 10]
    centers = clustering.model_centroids(df, model, order)
    assert [r.cluster_label for r in centers.orderBy("cluster").collect()] == ["A", "B", "C"]
    near = {r.g_id: r for r in clustering.centroid_distances(assigned, centers).collect()}
    assert len(near) == 60 and all(r.centroid_dist < 1 for r in near.values())
    again = clustering.fit_clusterer(df, 3)
    assert clustering.assign_clusters(df, again, clustering.cluster_order(df, again)).exceptAll(assigned).count() == 0
    storage.save_clusterer(model, str(tmp_path / "model"))
    loaded = storage.load_clusterer(str(tmp_path / "model"))
    assert clustering.raw_assignment(df, loaded).exceptAll(clustering.raw_assignment(df, model)).count() == 0
    many = clustering.fit_clusterer(df, 27)
    found = clustering.model_centroids(df, many, clustering.cluster_order(df, many))
    assert {"Z", "AA"} <= {r.cluster_label for r in found.collect()}


def test_mean_centroids(spark):
    df = vectors(spark, [[0.0, 2.0], [2.0, 4.0], [7.0, 7.0]])
    assignment = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "g_id long, cluster int")
    got = {r.cluster: r.centroid for r in clustering.mean_centroids(df, assignment).collect()}
    assert got == {0: [1.0, 3.0], 1: [7.0, 7.0]}


def test_closest_songs_keep_ties_and_skip_unknown(spark):
    distances = [(n, 0, "A", 0.1) for n in range(40)] + [(50, 0, "A", 0.2), (51, 0, "A", 0.3), (52, 0, "A", 0.4), (53, 0, "A", None)]
    df = spark.createDataFrame(distances, "g_id long, cluster int, cluster_label string, centroid_dist double")
    kept = sorted(r.g_id for r in songs.closest_songs(df, 3).collect())
    assert kept == [*range(40), 50, 51]


def test_representatives_and_covers(spark):
    distances = spark.createDataFrame(
        [(1, 0, "A", 0.1), (2, 0, "A", 0.2), (3, 1, "B", 0.1)], "g_id long, cluster int, cluster_label string, centroid_dist double"
    )
    plays = spark.sql(
        """SELECT timestamp'2024-01-01' AS dt, 's' AS source, id AS play_id, 2024 AS year, 1 AS month,
           CASE WHEN id < 5 THEN 2 ELSE 3 END AS g_id, concat('title ', id) AS song, 'artist' AS artist, 'album' AS album
           FROM range(10)"""
    )
    meta = spark.createDataFrame(
        [(2, "u2", None), (3, "x/default_cover_image", None)], "id long, art_url string, header_url string"
    )
    found = songs.representative_songs(distances, plays, meta)
    assert sorted((r.cluster, r.id, r.song) for r in found.collect()) == [(0, 2, "title 0"), (1, 3, "title 5")]
    covers = {r.cluster: r.image for r in songs.cluster_covers(found, meta).collect()}
    assert covers == {0: "u2", 1: ""}
    assert songs.representative_songs(distances, plays, meta.where("id = 2")).count() == 1
    assert songs.representative_songs(distances, plays.where("false"), meta).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 1])
@pytest.mark.parametrize("partitions", [1, 4])
def test_zero_and_broken_vectors_displace_no_hit(spark, broadcast_bytes, partitions):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(22, 4))
    corpus[[3, 11]] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(corpus)] + [(50, [1.0, None, 1.0, 1.0]), (51, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1).repartition(partitions)
    queries = rng.normal(size=(3, 4))
    asked = vectors(spark, queries).withColumnRenamed("id", "search_num")
    for n in (5, 22, 30):
        got = search.vector_search(df, asked, n, broadcast_bytes=broadcast_bytes).orderBy("search_num", "rank").collect()
        assert [tuple(r) for r in got] == brute_force(corpus, queries, n)


def test_text_without_words_is_a_zero_vector(spark):
    from playlytics.functions.text import embed_texts

    rows = [(1, ""), (2, " \n"), (3, None), (4, "a b"), (5, "a b a b")]
    got = {r.id: r.embedding for r in embed_texts(spark.createDataFrame(rows, "id long, text string"), width=8).collect()}
    assert got[1] == got[2] == [0.0] * 8 and got[3] is None and got[4] == got[5]
    assert sum(x * x for x in got[4]) == pytest.approx(1)


def test_widths_and_missing_elements(spark):
    from playlytics.sources import tables

    schema = "id long, embedding array<double>"
    assert tables.vector_width(spark.createDataFrame([(1, None), (2, [1.0, 2.0])], schema)) == 2
    for rows in ([(1, None)], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            tables.vector_width(spark.createDataFrame(rows, schema))
    broken = tables.fixed_width_vectors(spark.createDataFrame([(1, [1.0, None])], schema), 2)
    with pytest.raises(Exception, match="not a vector of 2"):
        broken.collect()


def test_letters(spark):
    from pyspark.sql import functions as F

    from playlytics.sources import tables

    rows = spark.createDataFrame([(n,) for n in (0, 25, 26, 51, 52, 701, 702, 18277, 18278, None)], "n int")
    got = [r[0] for r in rows.select(tables.cluster_letter(F.col("n"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ", "AAAA", None]
