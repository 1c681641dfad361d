"""Registered queries: each runs an operator over whole tables of a data folder.

Timestamps are given as microseconds, dates as text, floats at six digits and vectors as text, so that the
results compare exactly with the SQL in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlytics.config import DEFAULTS
from playlytics.functions import calendar, images, text, vectors
from playlytics.operators import (
    clustering,
    graph,
    latent,
    matching,
    rollups,
    search,
    sessions,
    similarity,
    songs,
    stats,
    traits,
)
from playlytics.plans import incremental
from playlytics.sources import results, storage, tables
from playlytics.sources.driver_tables import Inputs, StreamInputs
from playlytics.streaming import sessions as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MONTH = ("year", "month")


def query(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Inputs(spark, folder))
    return function


def r6(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def vector_text(column: str | Column) -> Column:
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))
    return F.array_join(scaled, ",", "null")


def day(column: str | Column = "date") -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# --- inputs shared by the queries ---


def plays(i: Inputs) -> DataFrame:
    return matching.match_plays(
        i.streams(), i.scrobbles(), i.stream_matches(), tables.drop_null_matches(i.scrobble_matches())
    )


def expanded(i: Inputs) -> DataFrame:
    return calendar.calendar_features(plays(i))


def clustered(i: Inputs) -> DataFrame:
    return matching.cluster_plays(expanded(i), i.song_clusters())


def in_sessions(i: Inputs) -> DataFrame:
    return sessions.assign_sessions(clustered(i))


def ordered(i: Inputs, by: tuple[str, ...] = (), previous: tuple[str, ...] = ("cluster",)) -> DataFrame:
    keep = ("dt", "source", "play_id", "listener", "g_id", "cluster", "year", "month")
    return sessions.order_within_sessions(clustered(i).select(*keep), by=by, previous=previous)


def labels(i: Inputs) -> DataFrame:
    return tables.cluster_labels(i.song_clusters())


def centroid_table(i: Inputs) -> DataFrame:
    return clustering.mean_centroids(i.vectors(), i.song_clusters())


def distances(i: Inputs) -> DataFrame:
    members = i.vectors().withColumnRenamed("id", "g_id").join(i.song_clusters(), "g_id")
    return clustering.centroid_distances(members, centroid_table(i))


def centroid_queries(i: Inputs) -> DataFrame:
    return vectors.normalise_rows(
        centroid_table(i).select(F.col("cluster").alias("search_num"), F.col("centroid").alias("embedding"))
    )


def searchable(i: Inputs) -> DataFrame:
    v = i.vectors()
    return search.search_table(v, tables.vector_width(v))


# --- sources and sinks ---


@query
def scan_projection(i):
    return tables.read_files(i.spark, f"{i.folder}/events.parquet", ["event_id", "user_id", "event_type"])


@query
def drop_prefixed(i):
    loaded = i.read("orders").withColumns({"_dlt_id": F.md5(F.col("o_orderkey").cast("string")), "_dlt_load_id": F.lit("1")})
    return tables.drop_prefixed(loaded).withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


@query
def param_query(i):
    sql = """SELECT source, count(*) AS n, sum(n_chars) AS total_chars FROM parquet.`{path}`
             WHERE array_contains(:langs, lang) GROUP BY source"""
    path = f"{i.folder}/documents.parquet"
    return tables.run_query(i.spark, sql.format(path=path), {"langs": F.array(F.lit("en"), F.lit("de"))})


@query
def drop_null_matches(i):
    return tables.drop_null_matches(i.scrobble_matches())


@query
def duplicate_match_keys(i):
    """The match keys a coarser key (the artist) would duplicate."""
    return tables.duplicate_keys(i.scrobble_matches(), ["artist"])


@query
def cluster_labels(i):
    counts = i.song_clusters().groupBy("cluster").agg(F.count(F.lit(1)).alias("n_songs"))
    return labels(i).join(counts, "cluster", "left").withColumn("n_songs", F.coalesce("n_songs", F.lit(0)))


@query
def vector_cast_check(i):
    v = i.vectors()
    return tables.vector_check(v, tables.vector_width(v))


@query
def materialize_roundtrip(i):
    path = storage.scratch_path(i.spark, "plays")
    storage.write_by_month(clustered(i), path)
    return i.spark.read.parquet(path).groupBy("year", "month", "cluster", "timebin").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_roundtrip(i):
    path = storage.scratch_path(i.spark, "graph")
    s = ordered(i)
    storage.save_graph(graph.graph_nodes(s, labels(i)), graph.graph_edges(s), path)
    nodes, edges = storage.load_graph(i.spark, path)
    ends = nodes.select("cluster", F.col("weight").alias("node_weight"))
    return edges.join(ends, "cluster", "left")


def _fitted(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    """The vectors, their assignment and the centers of a fitted model, and the model."""
    v = i.vectors()
    model = clustering.fit_clusterer(v)
    order = clustering.cluster_order(v, model)
    return v, clustering.assign_clusters(v, model, order), clustering.model_centroids(v, model, order), model


@query
def kmeans_fit(i):
    """Each center of the model against the mean of its members, and the clusters in order of size."""
    v, assigned, centers, _ = _fitted(i)
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    later = sizes.select((F.col("cluster") - 1).alias("cluster"), F.col("n").alias("n_next"))
    means = clustering.mean_centroids(v, assigned.select("g_id", "cluster")).select("cluster", F.col("centroid").alias("mean"))
    near = vectors.l2_distance(F.col("centroid"), F.col("mean")) < 0.01
    return (
        centers.join(means, "cluster", "left")
        .join(sizes, "cluster", "left")
        .join(later, "cluster", "left")
        .select("cluster", "cluster_label", near.alias("is_mean"), (F.col("n") >= F.coalesce("n_next", F.lit(0))).alias("in_order"))
    )


@query
def kmeans_sizes(i):
    """Fits of several sizes: the cost against that of the size before, and the silhouette against its range."""
    found = clustering.compare_sizes(i.vectors(), [2, 4, 7])
    before = F.lag("cost").over(Window.orderBy("k"))  # one row per size
    return found.select(
        "k", "n_clusters", F.coalesce(F.col("cost") <= before, F.lit(True)).alias("cost_falls"), F.col("silhouette").between(-1, 1).alias("in_range")
    )


@query
def stored_result(i):
    """A result that is computed, stored and then read from its store."""
    kept = results.Results(i.spark, storage.scratch_path(i.spark, "results"), max_age=3600)
    compute = lambda: stats.cluster_pie(stats.cluster_stats(in_sessions(i), centroid_table(i)))
    kept.get("cluster pie", compute)

    def again():
        raise RuntimeError("the stored result was not found")

    return kept.get("cluster pie", again)


@query
def kmeans_model_roundtrip(i):
    """Every song's cluster by the model that was saved and loaded again, against the fitted one."""
    v, _, _, model = _fitted(i)
    path = storage.scratch_path(i.spark, "clusterer")
    storage.save_clusterer(model, path)
    again = clustering.raw_assignment(v, storage.load_clusterer(path)).select("id", F.col("model_cluster").alias("loaded"))
    return clustering.raw_assignment(v, model).join(again, "id").select("id", (F.col("model_cluster") == F.col("loaded")).alias("same"))


# --- plays and calendar ---


@query
def uri_track_id(i):
    return i.streams().select("play_id", text.uri_field(F.col("track_uri")).alias("track_id"))


@query
def plays_union(i):
    return plays(i).withColumn("dt", F.unix_micros("dt"))


@query
def calendar_features(i):
    columns = ("year", "month", "day", "weekday", "time_us", "hour", "is_weekend", "dectime", "timebin")
    return rounded(expanded(i).select("source", "play_id", *columns), "dectime")


@query
def time_bins(i):
    return expanded(i).groupBy("timebin_no", "timebin", "hour").agg(F.count(F.lit(1)).alias("n"))


@query
def month_filter(i):
    return calendar.filter_month(expanded(i), 2024, 1).select("source", "play_id", "year", "month", "day")


@query
def month_filter_pruned(i):
    """The plays of a month from a table partitioned by month, whose partitions are pruned by a dimension table."""
    plays_path, months_path = (storage.scratch_path(i.spark, name) for name in ("by-month", "months"))
    storage.write_by_month(expanded(i).select("source", "play_id", "year", "month", "day"), plays_path)
    by_month = i.spark.read.parquet(plays_path)
    storage.write_table(calendar.month_dimension(by_month), months_path)
    return calendar.filter_months(by_month, i.spark.read.parquet(months_path).where("label = 'January 2024'"))


@query
def month_list(i):
    return calendar.month_list(in_sessions(i)).withColumn("date", day())


# --- sessions ---


@query
def plays_clustered(i):
    return ordered(i).select("source", "play_id", "g_id", "cluster", "year", "month", "timediff_us")


@query
def play_gaps(i):
    return ordered(i, by=("listener",)).select("listener", "source", "play_id", "timediff_us")


SESSION_COLUMNS = (
    "session", "ses_dur_us", "ses_len", "n_within_ses", "timediff_us", "cluster", "prev_cluster", "cluster_label",
    "g_id", "year", "month", "source", "play_id",
)


def _session_rows(i: Inputs, by: tuple[str, ...]) -> DataFrame:
    rows = ordered(i, by=by).join(labels(i), "cluster", "left")
    micros = [F.unix_micros(c).alias(c) for c in ("dt", "ses_start", "ses_end")]
    return rows.select(*by, *micros, *SESSION_COLUMNS)


@query
def sessions_global(i):
    return _session_rows(i, ())


@query
def sessions_by_listener(i):
    return _session_rows(i, ("listener",))


# --- a history that grows ---

URGENT = "1-URGENT"


def _grown(i: Inputs, by: tuple[str, ...] = ()) -> incremental.History:
    """All plays, added in three batches: most scrobbles, the streams, and late the urgent scrobbles, which fall into all months."""
    keep = ("dt", "source", "play_id", "listener", "g_id", "cluster", "year", "month", "album")
    all_plays = storage.materialise(clustered(i).select(*keep), "all-plays")
    history = incremental.History(storage.scratch_path(i.spark, "history"), by)
    late = (F.col("source") == "o") & (F.col("album") == URGENT)
    batches = {"scrobbles": (F.col("source") == "o") & ~late, "streams": F.col("source") == "s", "late": late}
    for name, those in batches.items():
        incremental.add_plays(history, all_plays.where(those).drop("album"), name)
    return history


@query
def incremental_sessions(i):
    rows = incremental.read_sessions(i.spark, _grown(i)).join(labels(i), "cluster", "left")
    return rows.select(*[F.unix_micros(c).alias(c) for c in ("dt", "ses_start", "ses_end")], *SESSION_COLUMNS)


@query
def incremental_listener_sessions(i):
    rows = incremental.read_sessions(i.spark, _grown(i, ("listener",))).join(labels(i), "cluster", "left")
    return rows.select("listener", *[F.unix_micros(c).alias(c) for c in ("dt", "ses_start", "ses_end")], *SESSION_COLUMNS)


@query
def incremental_month_stats(i):
    return rounded(incremental.read_month_stats(i.spark, _grown(i)).withColumn("date", day()), *MONTH_FLOATS)


@query
def incremental_song_counts(i):
    return incremental.read_song_counts(i.spark, _grown(i))


@query
def incremental_months(i):
    """Shares, diversity and personality scores of the months, from the counts of the stored history."""
    history = _grown(i)
    shares = rounded(incremental.read_cluster_month(i.spark, history, labels(i)), "cluster_freq")
    shares = shares.select(day().alias("date"), F.lit("share").alias("what"), F.col("cluster_label").alias("of"), F.col("cluster_freq").alias("value"))
    indices = rounded(incremental.read_diversity(i.spark, history), "gini", "shannon", "berger")
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("gini", "shannon", "berger")])).alias("x")
    indices = indices.select(day(F.make_date("year", "month", F.lit(1))).alias("date"), F.lit("diversity").alias("what"), names)
    scores = rounded(incremental.read_big5(i.spark, history, tables.trait_outputs(i.traits())), "score")
    scores = scores.select(day().alias("date"), F.lit("score").alias("what"), F.col("trait_short").alias("of"), F.col("score").alias("value"))
    return shares.unionByName(indices.select("date", "what", "x.of", "x.value")).unionByName(scores)


@query
def incremental_graph_month(i):
    nodes, edges = incremental.read_graph(i.spark, _grown(i), labels(i), MONTH)
    both = nodes.select(*MONTH, F.lit(None).cast("int").alias("prev_cluster"), "cluster", "name", "weight")
    return both.unionByName(edges.withColumn("name", F.lit(None).cast("string")))


@query
def stream_sessions(i):
    """The sessions of all listeners from a stream of both sources, closed at the end of the history."""
    beats, path, checkpoint = (storage.scratch_path(i.spark, f"stream-{x}") for x in ("beats", "sessions", "checkpoint"))
    streaming.write_heartbeat(i.spark, beats)
    arriving = plays(StreamInputs(i.spark, i.folder)).select("dt", "listener")
    found = streaming.stream_sessions(streaming.with_heartbeats(arriving, beats), by=("listener",))
    streaming.run_available(found, path, checkpoint)
    last = plays(i).agg(F.max("dt")).first()[0]
    if last is not None:
        streaming.end_stream(i.spark, beats, last)
        streaming.run_available(found, path, checkpoint)
    closed = i.spark.read.schema(found.schema).parquet(path)
    return closed.withColumns({c: F.unix_micros(c) for c in ("ses_start", "ses_end")})


# --- statistics ---


def _cluster_stats(i: Inputs, per: tuple[str, ...]) -> DataFrame:
    found = stats.cluster_stats(in_sessions(i), centroid_table(i), per=per)
    return rounded(found, "freq").withColumn("centroid", vector_text("centroid"))


@query
def cluster_stats(i):
    return _cluster_stats(i, ())


@query
def cluster_stats_month(i):
    return _cluster_stats(i, MONTH).drop("centroid")


@query
def cluster_stats_listener(i):
    """Statistics of all listeners together, each with a session numbering of their own."""
    found = stats.cluster_stats(sessions.assign_sessions(clustered(i), by=("listener",)), centroid_table(i), by=("listener",))
    return rounded(found, "freq").drop("centroid")


@query
def distinct_rollup(i):
    """Distinct songs and sessions per month and cluster, per month, per cluster and in all, merged from one pass over the plays."""
    keys, levels = ["g_id", "session"], [("year", "month", "cluster"), MONTH, ("cluster",), ()]
    fine = storage.materialise(rollups.distinct_bitmaps(in_sessions(i), keys, levels[0]), "bitmaps")
    found = None
    for per in levels:
        counts = rollups.count_distinct(rollups.merge_bitmaps(fine, per), keys, per)
        rows = counts.withColumn("level", F.lit(",".join(per)))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


@query
def median_rollup(i):
    """Median session lengths of every month from sketches per month and listener, against the exact ranks."""
    plays_in = sessions.assign_sessions(clustered(i), by=("listener",))
    fine = storage.materialise(rollups.sketches(plays_in, "ses_len", (*MONTH, "listener")), "sketches")
    counts = storage.materialise(plays_in.groupBy(*MONTH, "ses_len").agg(F.count(F.lit(1)).alias("n")), "lengths")
    guess = rollups.merge_sketches(fine, MONTH).select(*MONTH, rollups.quantile().alias("guess"))
    errors = rollups.rank_error(counts, guess, "ses_len", "guess", MONTH)
    exact = counts.groupBy(*MONTH).agg(F.sum("n").alias("n_plays"), F.expr("percentile(ses_len, 0.5, n)").alias("ses_len_median"))
    within = (F.col("error") <= rollups.RANK_BOUND).alias("within_bound")
    return exact.join(errors, list(MONTH)).select(*MONTH, "n_plays", "ses_len_median", within)


@query
def cluster_pie(i):
    return stats.cluster_pie(stats.cluster_stats(in_sessions(i), centroid_table(i)))


MONTH_FLOATS = (
    "ses_len_median", "ses_len_median_sessions", "cluster_mode_freq", "gini", "shannon", "berger",
)


@query
def month_stats(i):
    return rounded(stats.month_stats(in_sessions(i)).withColumn("date", day()), *MONTH_FLOATS)


@query
def listener_month(i):
    """Month statistics of every listener, each with a session numbering of their own."""
    s = sessions.assign_sessions(clustered(i), by=("listener",))
    found = stats.month_stats(s, per=("listener", *MONTH))
    return rounded(found.withColumn("date", day()), *MONTH_FLOATS)


@query
def diversity_month(i):
    return rounded(stats.diversity(clustered(i)), "gini", "shannon", "berger")


@query
def cluster_month(i):
    return rounded(stats.cluster_month(clustered(i), labels(i)), "cluster_freq").withColumn("date", day())


@query
def timebin_month(i):
    return stats.timebin_month(expanded(i)).withColumn("date", day())


@query
def hour_histogram(i):
    return stats.hour_histogram(clustered(i), labels(i))


@query
def graph_nodes(i):
    return graph.graph_nodes(clustered(i), labels(i))


@query
def graph_edges(i):
    return graph.graph_edges(ordered(i))


@query
def graph_nodes_month(i):
    s = ordered(i)
    return graph.graph_nodes(s, labels(i), MONTH, graph.graph_edges(s, MONTH))


@query
def graph_edges_month(i):
    return graph.graph_edges(ordered(i), MONTH)


@query
def network_nodes(i):
    s = storage.materialise(ordered(i), "ordered")
    examples = songs.representative_songs(distances(i), plays(i), i.songs())
    return graph.network(graph.graph_nodes(s, labels(i)), graph.graph_edges(s), songs.cluster_covers(examples, i.songs()))[0]


def _drawing(nodes: DataFrame, edges: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Nodes and edges in one result."""
    node = nodes.select(*per, F.lit("node").alias("kind"), F.lit(None).cast("int").alias("prev_cluster"), "cluster", "label", "title", "image", "weight")
    none = [F.lit(None).cast("string").alias(c) for c in ("label", "title", "image")]
    return node.unionByName(edges.select(*per, F.lit("edge").alias("kind"), "prev_cluster", "cluster", *none, "weight"))


@query
def network_payload(i):
    s = storage.materialise(ordered(i), "ordered")
    examples = songs.representative_songs(distances(i), plays(i), i.songs())
    return _drawing(*graph.network(graph.graph_nodes(s, labels(i)), graph.graph_edges(s), songs.cluster_covers(examples, i.songs())))


@query
def network_payload_month(i):
    """The drawing of every month: covers are chosen among the songs played in it."""
    s = storage.materialise(ordered(i), "ordered")
    edges = graph.graph_edges(s, MONTH)
    examples = songs.representative_songs(distances(i), expanded(i), i.songs(), per=MONTH)
    covers = songs.cluster_covers(examples, i.songs(), MONTH)
    return _drawing(*graph.network(graph.graph_nodes(s, labels(i), MONTH, edges), edges, covers, MONTH), MONTH)


@query
def cluster_cover_month(i):
    examples = songs.representative_songs(distances(i), expanded(i), i.songs(), per=MONTH)
    return songs.cluster_covers(examples, i.songs(), MONTH)


def _big5(i: Inputs) -> DataFrame:
    return traits.big5_by_month(expanded(i), tables.trait_outputs(i.traits()))


@query
def big5_month(i):
    return rounded(_big5(i), "logit", "score", "score_pct").withColumn("date", day())


@query
def big5_overall(i):
    return rounded(traits.big5_overall(_big5(i)), "score", "score_pct")


@query
def latent_distance_month(i):
    s = ordered(i, previous=("g_id",))
    found = latent.latent_distance_month(s, i.vectors())
    return rounded(found, "latent_dist_mean").withColumn("date", day())


# --- clusters and songs ---


@query
def centroids(i):
    return centroid_table(i).withColumn("centroid", vector_text("centroid"))


@query
def centroid_distance(i):
    return rounded(distances(i), "centroid_dist")


@query
def assign_clusters(i):
    """Every song's cluster against the center at the smallest distance, found without the model."""
    _, assigned, centers, _ = _fitted(i)
    listed = centers.agg(F.collect_list(F.struct("cluster", "centroid")).alias("centers"))  # one row per cluster
    away = F.transform("centers", lambda c: F.struct(vectors.l2_distance(c["centroid"], F.col("embedding")).alias("d"), c["cluster"]))
    own = F.element_at(F.filter("centers", lambda c: c["cluster"] == F.col("cluster")), 1)["centroid"]
    # a tie may go to either center
    nearest = vectors.l2_distance(own, F.col("embedding")) <= F.array_min(away)["d"] + 1e-9
    labelled = F.col("cluster_label") == tables.cluster_letter(F.col("cluster"))
    return assigned.withColumn("centers", listed.scalar()).select("g_id", nearest.alias("is_nearest"), labelled.alias("labelled"))


BUCKETS = 16


@query
def centroid_distance_colocated(i):
    """Distances where vectors and assignment are stored in buckets by song, and joined where they lie."""
    path = lambda name: storage.scratch_path(i.spark, name)
    members = storage.write_bucketed(i.vectors().withColumnRenamed("id", "g_id"), path("vectors"), "g_id", BUCKETS)
    assigned = storage.write_bucketed(i.song_clusters(), path("assigned"), "g_id", BUCKETS)
    return rounded(clustering.centroid_distances(members.join(assigned, "g_id"), centroid_table(i)), "centroid_dist")


@query
def representative_songs(i):
    return rounded(songs.representative_songs(distances(i), plays(i), i.songs()), "centroid_dist")


@query
def representative_songs_month(i):
    found = songs.representative_songs(distances(i), expanded(i), i.songs(), per=MONTH)
    return rounded(found, "centroid_dist")


@query
def representative_songs_within_month(i):
    """The closest among the songs that were played in the month."""
    found = songs.representative_songs(distances(i), expanded(i), i.songs(), per=MONTH, rank_within=True)
    return rounded(found, "centroid_dist")


@query
def cluster_cover(i):
    examples = songs.representative_songs(distances(i), plays(i), i.songs())
    return songs.cluster_covers(examples, i.songs())


@query
def image_url(i):
    return songs.song_images(i.songs())


@query
def image_from_json(i):
    picture = F.struct(F.col("url").alias("#text"))
    small = F.struct(F.concat(F.col("url"), F.lit("#small")).alias("#text"))
    album = F.when(F.col("url").isNotNull(), F.struct(F.array(small, picture).alias("image")))
    answer = F.to_json(F.struct(F.struct(album.alias("album")).alias("track")))
    return i.songs().select("id", answer.alias("answer")).select("id", images.image_from_json(F.col("answer")).alias("image"))


@query
def song_metadata(i):
    """Every song as the metadata of a search hit."""
    hits = i.songs().select(F.col("title").alias("search"), F.lit(0).alias("rank"), "id")
    return songs.song_metadata(hits, i.songs())


@query
def similarity_graph(i):
    """Every song with the number of its neighbours, and whether their weights are the cosines and in range of the graph's."""
    edges = similarity.neighbour_graph(i.vectors())
    unit = vectors.normalise_rows(i.vectors().withColumn("embedding", F.col("embedding").cast("array<double>")))
    ends = lambda name: unit.select(F.col("id").alias(name), F.col("embedding").alias(f"{name}_v"))
    cosine = F.aggregate(F.zip_with("src_v", "dst_v", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    checked = edges.join(ends("src"), "src").join(ends("dst"), "dst").withColumn("right", F.abs(cosine - F.col("weight")) < 1e-9)
    counts = checked.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n_neighbours"), F.bool_and("right").alias("weights_right"))
    return i.vectors().select("id").join(counts, "id", "left")


@query
def spectral_clusters(i):
    """Every song of the graph of strong similarities, and whether it is in exactly one of the communities."""
    edges = storage.materialise(similarity.strongest(similarity.undirected(similarity.neighbour_graph(i.vectors()))), "edges")
    nodes = edges.where("weight > 0").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    found = similarity.communities(edges).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("community").alias("first"), F.max("community").alias("last")
    )
    one = (F.col("n") == 1) & (F.col("first") >= 0) & (F.col("last") < DEFAULTS.n_clusters)
    ids = i.vectors().select("id").join(nodes.withColumn("in_graph", F.lit(True)), "id", "left").join(found, "id", "left")
    return ids.select("id", F.when(F.col("in_graph"), F.coalesce(one, F.lit(False))).otherwise(F.col("n").isNull()).alias("as_it_should"))


# --- vectors and search ---


@query
def query_prompt(i):
    return i.read("documents").select("doc_id", F.md5(text.search_prompt(F.col("text"))).alias("prompt_md5"))


@query
def normalize_vectors(i):
    return vectors.normalise_rows(i.vectors()).select("id", vector_text("embedding").alias("unit"))


@query
def normalize_query_compat(i):
    return vectors.normalise_columns(i.vectors()).select("id", vector_text("embedding").alias("scaled"))


@query
def search_table(i):
    return searchable(i).select("id", vector_text("embedding").alias("embedding"))


@query
def vector_search(i):
    return rounded(search.vector_search(searchable(i), centroid_queries(i)), "dist")


@query
def vector_search_blocks(i):
    """The same search with the queries in several slices, as for batches too large for one broadcast."""
    return rounded(search.vector_search(searchable(i), centroid_queries(i), broadcast_bytes=2_048), "dist")


@query
def vector_search_sql(i):
    """The same search in built-in expressions."""
    return rounded(search.vector_search(searchable(i), centroid_queries(i), candidates=search.score_all), "dist")


@query
def vector_search_zero(i):
    """Search among vectors of which a fifth is zero: a zero vector scores 0 and displaces no better one."""
    zero = F.when(F.col("id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    return rounded(search.vector_search(searchable(i).withColumn("embedding", zero), centroid_queries(i)), "dist")


@query
def search_bounded(i):
    return rounded(search.vector_search(searchable(i), centroid_queries(i), 20, min_dist=0.3, max_dist=0.4), "dist")


def _searches(i: Inputs) -> DataFrame:
    return i.read("benchmark").select(F.col("item_id").alias("search_num"), F.col("text").alias("search"))


def _document_vectors(i: Inputs) -> DataFrame:
    documents = i.read("documents").select(F.col("doc_id").alias("id"), "text")
    return text.embed_texts(tables.spread(documents)).select("id", "embedding")


@query
def embed_texts(i):
    return _document_vectors(i).select("id", vector_text("embedding").alias("embedding"))


@query
def text_search(i):
    return rounded(search.text_search(_searches(i), _document_vectors(i), width=64), "dist").drop("search")


@query
def search_metadata(i):
    hits = search.text_search(_searches(i), _document_vectors(i), width=64)
    return songs.search_result_table(songs.song_metadata(hits, i.songs()))


@query
def search_metadata_colocated(i):
    """Metadata of hits from songs that are stored in buckets by id: the few hits move, the songs do not."""
    known = storage.write_bucketed(i.songs(), storage.scratch_path(i.spark, "songs"), "id", BUCKETS)
    hits = search.text_search(_searches(i), _document_vectors(i), width=64)
    return songs.search_result_table(songs.song_metadata(hits, known))
