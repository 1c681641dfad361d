"""The same results in plain SQL, one statement per registered query, for DuckDB on the same tables."""

from __future__ import annotations

from playlytics.config import DEFAULT_COVER, DEFAULTS, MICROS_PER_DAY, TRAITS, TRAITS_NEGATIVE, TRAITS_POSITIVE, TRAITS_SHORT


def r6(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def vector_text(expression: str) -> str:
    scaled = f"CAST(CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS VARCHAR)"
    return f"array_to_string(list_transform({expression}, lambda x: coalesce({scaled}, 'null')), ',')"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


MATCHED = """matched AS (
  SELECT d.doc_id, CASE WHEN coalesce(l.quality = 0 OR l.toxic = 1, FALSE) THEN NULL ELSE d.doc_id END AS g_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

STREAMS = """streams AS (
  SELECT ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, event_id, user_id FROM events)"""

PLAYS = f"""{MATCHED}, {STREAMS}, plays AS (
  SELECT s.ts AS dt, 'song ' || s.k AS song, s.event_type AS album, 'artist ' || (s.k // 10) AS artist, m.g_id,
         's' AS source, s.event_id AS play_id, s.user_id AS listener
  FROM streams s LEFT JOIN matched m ON m.doc_id = s.k
  UNION ALL
  SELECT o.o_orderdate, 'song ' || (o.o_custkey // 4), o.o_orderpriority, 'artist ' || (o.o_custkey // 40), m.g_id,
         'o', o.o_orderkey, o.o_custkey
  FROM orders o LEFT JOIN matched m ON m.doc_id = o.o_custkey // 4 AND m.g_id IS NOT NULL)"""

EXPANDED = f"""{PLAYS}, localised AS (
  SELECT *, timezone('US/Eastern', timezone('UTC', dt)) AS l FROM plays), expanded0 AS (
  SELECT *, year(l) AS year, month(l) AS month, day(l) AS day, isodow(l) - 1 AS weekday,
         epoch_us(l) - epoch_us(date_trunc('day', l)) AS time_us, hour(l) AS hour, isodow(l) >= 6 AS is_weekend,
         hour(l) + minute(l) / 60.0::DOUBLE + second(l) / 3600.0::DOUBLE AS dectime FROM localised), expanded AS (
  SELECT *, CASE WHEN hour BETWEEN 3 AND 8 THEN 0 WHEN hour BETWEEN 9 AND 14 THEN 1 WHEN hour BETWEEN 15 AND 20 THEN 2
            ELSE 3 END AS timebin_no,
         CASE WHEN hour BETWEEN 3 AND 8 THEN 'morning' WHEN hour BETWEEN 9 AND 14 THEN 'midday'
              WHEN hour BETWEEN 15 AND 20 THEN 'evening' ELSE 'night' END AS timebin FROM expanded0)"""

CLUSTERED = f"""{EXPANDED}, clustered AS (
  SELECT p.*, e.label AS cluster FROM expanded p LEFT JOIN embeddings e ON e.vec_id = p.g_id)"""


def sessions(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    also = f"{by}, " if by else ""
    return f"""{CLUSTERED}, gaps AS (
  SELECT *, epoch_us(dt) - lag(epoch_us(dt)) OVER ({part} ORDER BY dt, source, play_id, g_id) AS timediff_us FROM clustered),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN timediff_us > {MICROS_PER_DAY} THEN 1 ELSE 0 END)
    OVER ({part} ORDER BY dt, source, play_id, g_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps),
sessions AS (
  SELECT *, lag(cluster) OVER inside AS prev_cluster, lag(g_id) OVER inside AS prev_g_id,
         row_number() OVER inside - 1 AS n_within_ses, min(dt) OVER whole AS ses_start, max(dt) OVER whole AS ses_end,
         count(*) OVER whole AS ses_len
  FROM numbered
  WINDOW inside AS (PARTITION BY {also}session ORDER BY dt, source, play_id, g_id), whole AS (PARTITION BY {also}session))"""


GLOBAL = sessions()

MEANS = """elements AS (
  SELECT label AS cluster, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT cluster, pos, avg(v) AS v FROM elements GROUP BY ALL),
centroids AS (
  SELECT cluster, chr(65 + cluster) AS cluster_label, list(v ORDER BY pos) AS centroid FROM means GROUP BY cluster)"""

DISTANCES = f"""{MEANS}, distances AS (
  SELECT e.vec_id AS g_id, c.cluster, c.cluster_label,
         sqrt(list_sum(list_transform(list_zip(c.centroid, e.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))
         AS centroid_dist
  FROM embeddings e JOIN centroids c ON c.cluster = e.label)"""

LABELS = "labels_of AS (SELECT DISTINCT label AS cluster, chr(65 + label) AS cluster_label FROM embeddings)"

SONGS = f"""songs AS (
  SELECT d.doc_id AS id, 'song ' || d.doc_id AS title, d.source AS artist, d.lang AS album,
         CAST(d.n_chars AS VARCHAR) AS release_date, p.url,
         CASE WHEN l.quality = 1 THEN p.url ELSE 'https://img.example.com/{DEFAULT_COVER}.png' END AS art,
         CASE WHEN d.lang = 'en' THEN 'https://img.example.com/{DEFAULT_COVER}.png' ELSE p.url END AS header
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
images AS (
  SELECT id, CASE WHEN art NOT LIKE '%{DEFAULT_COVER}%' THEN art WHEN header NOT LIKE '%{DEFAULT_COVER}%' THEN header END
         AS image FROM songs)"""


def cluster_stats(per: str = "", session: str = "session") -> str:
    also = f"{per}, " if per else ""
    part = f"PARTITION BY {per}" if per else ""
    periods = f"(SELECT DISTINCT {per} FROM sessions) CROSS JOIN" if per else ""
    keys = [*(per.split(", ") if per else []), "cluster"]
    on = " AND ".join(f"s.{k} = w.{k}" for k in keys)
    merged = ", ".join(f"coalesce(s.{k}, w.{k}) AS {k}" for k in keys)
    return f"""per_song AS (SELECT {also}cluster, g_id, count(*) AS n FROM sessions GROUP BY ALL),
top AS (SELECT {also}cluster, g_id AS top_song_id FROM per_song
  QUALIFY row_number() OVER (PARTITION BY {also}cluster ORDER BY n DESC, g_id NULLS LAST) = 1),
counted AS (
  SELECT {also}cluster, count(*) AS n_plays, count(DISTINCT g_id) + max(CASE WHEN g_id IS NULL THEN 1 ELSE 0 END)
         AS n_unique_plays, count(DISTINCT {session}) AS n_sessions FROM sessions GROUP BY ALL),
found AS (
  SELECT c.*, t.top_song_id, n_plays / sum(n_plays) OVER ({part.replace(per, ', '.join('c.' + k for k in per.split(', '))) if per else ''}) AS freq
  FROM counted c JOIN top t ON {" AND ".join(f"c.{k} IS NOT DISTINCT FROM t.{k}" for k in keys)}),
wanted AS (SELECT * FROM {periods} (SELECT cluster FROM centroids)),
stats AS (
  SELECT {merged}, coalesce(freq, 0) AS freq, coalesce(n_plays, 0) AS n_plays,
         coalesce(n_unique_plays, 0) AS n_unique_plays, coalesce(n_sessions, 0) AS n_sessions, top_song_id
  FROM found s FULL JOIN wanted w ON {on})"""


def month_stats(per: str = "year, month") -> str:
    using = f"USING ({per})"
    return f"""pieces AS (SELECT {per}, session, ses_len, count(*) AS n FROM sessions GROUP BY ALL),
by_session AS (
  SELECT {per}, count(*) AS n_sessions_in_month, median(ses_len) AS ses_len_median_sessions FROM pieces GROUP BY ALL),
by_play AS (
  SELECT {per}, count(*) AS n_plays, max(session) + 1 AS n_sessions, median(ses_len) AS ses_len_median,
         max(ses_len) AS ses_len_max FROM sessions GROUP BY ALL),
by_cluster AS (SELECT {per}, cluster, count(*) AS n FROM sessions GROUP BY ALL),
modes AS (
  SELECT {per}, cluster AS cluster_mode, CASE WHEN cluster IS NULL THEN 0 ELSE n END AS cluster_mode_count FROM by_cluster
  QUALIFY row_number() OVER (PARTITION BY {per} ORDER BY n DESC, cluster NULLS LAST) = 1),
shares AS (SELECT {per}, n, n / sum(n) OVER (PARTITION BY {per}) AS p FROM by_cluster),
indices AS (
  SELECT {per}, 1 - sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE) AS gini, sum(-p * log2(p)) AS shannon, 1 / max(p) AS berger FROM shares GROUP BY ALL)
SELECT {day("make_date(year, month, 1)")} AS date, {per}, n_plays, n_sessions, n_sessions_in_month,
       {r6("ses_len_median")} AS ses_len_median, {r6("ses_len_median_sessions")} AS ses_len_median_sessions, ses_len_max,
       cluster_mode, cluster_mode_count, {r6("cluster_mode_count / n_plays")} AS cluster_mode_freq,
       {r6("gini")} AS gini, {r6("shannon")} AS shannon, {r6("berger")} AS berger
FROM by_play JOIN by_session {using} JOIN modes {using} JOIN indices {using}"""


SESSION_SELECT = """epoch_us(dt) AS dt, epoch_us(ses_start) AS ses_start, epoch_us(ses_end) AS ses_end, session,
  epoch_us(ses_end) - epoch_us(ses_start) AS ses_dur_us, ses_len, n_within_ses, timediff_us, cluster, prev_cluster,
  chr(65 + cluster) AS cluster_label, g_id, year, month, source, play_id"""


def traits_sql() -> str:
    rows = zip(range(5), TRAITS, TRAITS_SHORT, TRAITS_POSITIVE, TRAITS_NEGATIVE)
    values = ", ".join(f"({n}, '{a}', '{b}', '{c}', '{d}')" for n, a, b, c, d in rows)
    return f"""names(n, trait, trait_short, trait_pos, trait_neg) AS (VALUES {values}),
logits AS (SELECT vec_id AS g_id, unnest(range(5)) AS n, unnest(embedding[1:5])::DOUBLE * 4 AS logit FROM embeddings),
means AS (
  SELECT p.year, p.month, x.n, avg(x.logit) AS logit FROM expanded p JOIN logits x ON x.g_id = p.g_id GROUP BY ALL),
monthly AS (
  SELECT make_date(year, month, 1) AS date, logit, trait, trait_short, trait_pos, trait_neg,
         CASE WHEN logit >= 0 THEN trait_pos ELSE trait_neg END AS trait_desc, tanh(logit) AS score,
         abs(tanh(logit)) * 100 AS score_pct
  FROM means JOIN names USING (n))"""


def representatives(per: str = "") -> str:
    also = f"{per}, " if per else ""
    return f"""{DISTANCES}, ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY cluster ORDER BY centroid_dist) AS r FROM distances),
examples AS (
  SELECT {also}d.cluster, d.cluster_label, d.g_id AS id, d.centroid_dist, p.song, p.artist, p.album
  FROM ranked d JOIN expanded p ON p.g_id = d.g_id
  WHERE d.r <= 3 AND d.g_id IN (SELECT id FROM songs)
  QUALIFY row_number() OVER (PARTITION BY {also}d.cluster, d.g_id ORDER BY dt, source, play_id, song, artist, album) = 1),
covers AS (
  SELECT {also}e.cluster, e.cluster_label, e.id, e.song, e.artist, coalesce(i.image, '') AS image
  FROM examples e LEFT JOIN images i ON i.id = e.id
  QUALIFY row_number() OVER (PARTITION BY {also}e.cluster ORDER BY e.centroid_dist, e.id) = 1)"""


def product(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def hits(n: int, corpus: str = "embedding::DOUBLE[]") -> str:
    return f"""{MEANS}, queries AS (
  SELECT cluster AS search_num, list_transform(centroid, lambda x: x / sqrt(list_inner_product(centroid, centroid))) AS q
  FROM centroids), scored AS (
  SELECT search_num, vec_id AS id, round({product("q", corpus)}, 12) AS dist FROM queries, embeddings),
hits AS (
  SELECT search_num, row_number() OVER (PARTITION BY search_num ORDER BY dist DESC, id) - 1 AS rank, id, dist
  FROM scored QUALIFY rank < {n})"""


def hashed(source: str, name: str) -> str:
    """Signed hashed word counts of (id, text) rows as unit vectors (id, v)."""
    return f"""{name}_words AS (
  SELECT id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS w FROM {source}),
{name}_slots AS (
  SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS slot, count(*) AS n
  FROM {name}_words WHERE w <> '' GROUP BY ALL),
{name}_grid AS (SELECT s.id, r.range AS pos FROM {source} s, range(64) r),
{name}_counts AS (
  SELECT g.id, g.pos, coalesce(a.n, 0) - coalesce(b.n, 0) AS c FROM {name}_grid g
  LEFT JOIN {name}_slots a ON a.id = g.id AND a.slot = g.pos
  LEFT JOIN {name}_slots b ON b.id = g.id AND b.slot = g.pos + 64),
{name}_norms AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {name}_counts GROUP BY id),
{name} AS (
  SELECT c.id, list(coalesce(c.c / nullif(n.norm, 0), 0) ORDER BY c.pos) AS v
  FROM {name}_counts c JOIN {name}_norms n ON n.id = c.id GROUP BY c.id)"""


TEXT_HITS = f"""docs AS (SELECT doc_id AS id, text FROM documents),
asks AS (SELECT item_id AS id, 'task: search result | query: ' || replace(text, '|', '') AS text FROM benchmark),
{hashed("docs", "corpus")}, {hashed("asks", "wanted")}, scored AS (
  SELECT w.id AS search_num, c.id, round({product("w.v", "c.v")}, 12) AS dist FROM wanted w, corpus c),
hits AS (
  SELECT search_num, row_number() OVER (PARTITION BY search_num ORDER BY dist DESC, id) - 1 AS rank, id, dist
  FROM scored QUALIFY rank < 5)"""


#: queries that give the result of another one in another way
SAME = {
    "month_filter_pruned": "month_filter",
    "centroid_distance_colocated": "centroid_distance",
    "search_metadata_colocated": "search_metadata",
    "vector_search_sql": "vector_search",
    "stored_result": "cluster_pie",
    "incremental_sessions": "sessions_global",
    "incremental_listener_sessions": "sessions_by_listener",
    "incremental_month_stats": "month_stats",
}


def oracles() -> dict[str, str]:
    found = _oracles()
    found["incremental_months"] = f"""SELECT date, 'share' AS what, cluster_label AS of, cluster_freq AS value FROM ({found["cluster_month"]})
        UNION ALL SELECT {day("make_date(year, month, 1)")}, 'diversity', of, value FROM (
            UNPIVOT ({found["diversity_month"]}) ON gini, shannon, berger INTO NAME of VALUE value)
        UNION ALL SELECT date, 'score', trait_short, score FROM ({found["big5_month"]})"""
    found["incremental_graph_month"] = f"""
        SELECT year, month, NULL::INTEGER AS prev_cluster, cluster, name, weight FROM ({found["graph_nodes_month"]})
        UNION ALL SELECT year, month, prev_cluster, cluster, NULL, weight FROM ({found["graph_edges_month"]})"""
    return {**found, **{name: found[other] for name, other in SAME.items()}}


def _oracles() -> dict[str, str]:
    month_per_play = "year, month"
    return {
        "kmeans_sizes": "SELECT unnest([2, 4, 7])::INTEGER AS k, unnest([2, 4, 7])::INTEGER AS n_clusters, TRUE AS cost_falls, TRUE AS in_range",
        "scan_projection": "SELECT event_id, user_id, event_type FROM events",
        "drop_prefixed": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, "
        "o_orderpriority FROM orders",
        "param_query": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents "
        "WHERE lang IN ('en', 'de') GROUP BY source",
        "drop_null_matches": f"WITH {MATCHED} SELECT 'song ' || doc_id AS song, 'artist ' || (doc_id // 10) AS artist, g_id "
        "FROM matched WHERE g_id IS NOT NULL",
        "duplicate_match_keys": "SELECT 'artist ' || (doc_id // 10) AS artist, count(*) AS n FROM documents GROUP BY ALL "
        "HAVING count(*) > 1",
        "cluster_labels": f"WITH {LABELS} SELECT l.cluster, l.cluster_label, count(e.vec_id) AS n_songs FROM labels_of l "
        "LEFT JOIN embeddings e ON e.label = l.cluster GROUP BY ALL",
        "vector_cast_check": "SELECT count(*) FILTER (len(embedding) = 64) AS n_ok, count(*) FILTER (len(embedding) <> 64) AS "
        "n_wrong_width, count(*) FILTER (embedding IS NULL) AS n_missing FROM embeddings",
        "materialize_roundtrip": f"WITH {CLUSTERED} SELECT year, month, cluster, timebin, count(*) AS n FROM clustered GROUP BY ALL",
        "graph_roundtrip": f"""WITH {GLOBAL}, nodes AS (
            SELECT cluster, count(*) AS node_weight FROM sessions WHERE cluster IS NOT NULL GROUP BY ALL)
            SELECT s.prev_cluster, s.cluster, count(*) AS weight, any_value(n.node_weight) AS node_weight
            FROM sessions s JOIN nodes n ON n.cluster = s.cluster
            WHERE s.ses_len > 1 AND s.prev_cluster IS NOT NULL GROUP BY s.prev_cluster, s.cluster""",
        "uri_track_id": f"WITH {STREAMS} SELECT event_id AS play_id, CAST(k AS VARCHAR) AS track_id FROM streams",
        "plays_union": f"WITH {PLAYS} SELECT epoch_us(dt) AS dt, song, album, artist, g_id, source, play_id, listener FROM plays",
        "calendar_features": f"WITH {EXPANDED} SELECT source, play_id, year, month, day, weekday, time_us, hour, is_weekend, "
        f"{r6('dectime')} AS dectime, timebin FROM expanded",
        "time_bins": f"WITH {EXPANDED} SELECT timebin_no, timebin, hour, count(*) AS n FROM expanded GROUP BY ALL",
        "month_filter": f"WITH {EXPANDED} SELECT source, play_id, year, month, day FROM expanded WHERE year = 2024 AND month = 1",
        "month_list": f"""WITH bounds AS (
            SELECT date_trunc('month', max(l)) AS newest, date_trunc('month', min(l)) AS oldest
            FROM (SELECT timezone('US/Eastern', timezone('UTC', t)) AS l
                  FROM (SELECT ts AS t FROM events UNION ALL SELECT o_orderdate FROM orders))),
            months AS (SELECT unnest(generate_series(oldest, newest, INTERVAL 1 MONTH)) AS m FROM bounds)
            SELECT {day("m")} AS date, strftime(m, '%B %Y') AS label FROM months""",
        "plays_clustered": f"WITH {GLOBAL} SELECT source, play_id, g_id, cluster, year, month, timediff_us FROM sessions",
        "play_gaps": f"WITH {sessions('listener')} SELECT listener, source, play_id, timediff_us FROM sessions",
        "sessions_global": f"WITH {GLOBAL} SELECT {SESSION_SELECT} FROM sessions",
        "sessions_by_listener": f"WITH {sessions('listener')} SELECT listener, {SESSION_SELECT} FROM sessions",
        "incremental_song_counts": f"""WITH {CLUSTERED}, per_song AS (SELECT cluster, g_id, count(*) AS n FROM clustered GROUP BY ALL)
            SELECT cluster, CAST(sum(n) AS BIGINT) AS n_plays, count(*) AS n_unique_plays,
                   first(g_id ORDER BY n DESC, g_id NULLS LAST) AS top_song_id FROM per_song GROUP BY cluster""",
        "stream_sessions": f"""WITH {sessions('listener')} SELECT listener, epoch_us(any_value(ses_start)) AS ses_start,
            epoch_us(any_value(ses_end)) AS ses_end, epoch_us(any_value(ses_end)) - epoch_us(any_value(ses_start)) AS ses_dur_us,
            count(*) AS ses_len FROM sessions GROUP BY listener, session""",
        "distinct_rollup": f"""WITH {GLOBAL} SELECT concat_ws(',', CASE WHEN grouping(year) = 0 THEN 'year,month' END,
            CASE WHEN grouping(cluster) = 0 THEN 'cluster' END) AS level, year, month, cluster,
            count(DISTINCT g_id) + max(CASE WHEN g_id IS NULL THEN 1 ELSE 0 END) AS n_g_id, count(DISTINCT session) AS n_session
            FROM sessions GROUP BY GROUPING SETS ((year, month, cluster), (year, month), (cluster), ())""",
        "median_rollup": f"""WITH {sessions('listener')} SELECT year, month, count(*) AS n_plays, median(ses_len) AS ses_len_median,
            TRUE AS within_bound FROM sessions GROUP BY year, month""",
        "cluster_stats": f"WITH {GLOBAL}, {MEANS}, {cluster_stats()} SELECT s.cluster, c.cluster_label, {r6('freq')} AS freq, "
        f"n_plays, n_unique_plays, n_sessions, top_song_id, {vector_text('c.centroid')} AS centroid "
        "FROM stats s LEFT JOIN centroids c ON c.cluster = s.cluster",
        "cluster_stats_month": f"WITH {GLOBAL}, {MEANS}, {cluster_stats(month_per_play)} SELECT year, month, s.cluster, "
        f"c.cluster_label, {r6('freq')} AS freq, n_plays, n_unique_plays, n_sessions, top_song_id "
        "FROM stats s LEFT JOIN centroids c ON c.cluster = s.cluster",
        "cluster_stats_listener": f"WITH {sessions('listener')}, {MEANS}, {cluster_stats(session='(listener, session)')} SELECT s.cluster, "
        f"c.cluster_label, {r6('freq')} AS freq, n_plays, n_unique_plays, n_sessions, top_song_id "
        "FROM stats s LEFT JOIN centroids c ON c.cluster = s.cluster",
        "cluster_pie": f"WITH {CLUSTERED}, counted AS (SELECT cluster, count(*) AS n_plays FROM clustered GROUP BY ALL) "
        "SELECT 'Cluster ' || chr(65 + cluster) AS label, n_plays FROM counted",
        "month_stats": f"WITH {GLOBAL}, {month_stats()}",
        "listener_month": f"WITH {sessions('listener')}, {month_stats('listener, year, month')}",
        "diversity_month": f"""WITH {CLUSTERED}, counts AS (SELECT year, month, cluster, count(*) AS n FROM clustered GROUP BY ALL),
            shares AS (SELECT year, month, n, n / sum(n) OVER (PARTITION BY year, month) AS p FROM counts)
            SELECT year, month, {r6("1 - sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)::DOUBLE)")} AS gini, {r6("sum(-p * log2(p))")} AS shannon,
                   {r6("1 / max(p)")} AS berger FROM shares GROUP BY year, month""",
        "cluster_month": f"""WITH {CLUSTERED}, counts AS (SELECT year, month, cluster, count(*) AS n FROM clustered GROUP BY ALL),
            shares AS (SELECT *, n / sum(n) OVER (PARTITION BY year, month) AS f FROM counts)
            SELECT year, month, {day("make_date(year, month, 1)")} AS date, cluster, chr(65 + cluster) AS cluster_label,
                   n AS n_cluster_plays, {r6("f")} AS cluster_freq FROM shares WHERE cluster IS NOT NULL""",
        "timebin_month": f"WITH {EXPANDED} SELECT year, month, timebin_no, timebin, count(*) AS n, "
        f"{day('make_date(year, month, 1)')} AS date FROM expanded GROUP BY ALL",
        "hour_histogram": f"""WITH {CLUSTERED}, {LABELS}, counts AS (
            SELECT cluster, hour, count(*) AS n FROM clustered GROUP BY ALL)
            SELECT h.range AS hour, l.cluster, l.cluster_label, coalesce(c.n, 0) AS count
            FROM labels_of l CROSS JOIN range(24) h LEFT JOIN counts c ON c.cluster = l.cluster AND c.hour = h.range""",
        "graph_nodes": f"WITH {CLUSTERED} SELECT cluster, chr(65 + cluster) AS name, count(*) AS weight FROM clustered "
        "WHERE cluster IS NOT NULL GROUP BY ALL",
        "graph_edges": f"WITH {GLOBAL} SELECT prev_cluster, cluster, count(*) AS weight FROM sessions WHERE ses_len > 1 "
        "AND prev_cluster IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL",
        "graph_nodes_month": f"""WITH {GLOBAL}, ends AS (
            SELECT year, month, cluster, 1 AS w FROM sessions WHERE cluster IS NOT NULL
            UNION ALL SELECT DISTINCT year, month, prev_cluster, 0 FROM sessions
            WHERE ses_len > 1 AND prev_cluster IS NOT NULL AND cluster IS NOT NULL)
            SELECT year, month, cluster, chr(65 + cluster) AS name, CAST(sum(w) AS BIGINT) AS weight FROM ends GROUP BY ALL""",
        "graph_edges_month": f"WITH {GLOBAL} SELECT year, month, prev_cluster, cluster, count(*) AS weight FROM sessions "
        "WHERE ses_len > 1 AND prev_cluster IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL",
        "network_nodes": f"""WITH {CLUSTERED}, {SONGS}, {representatives()}, counts AS (
            SELECT cluster, count(*) AS weight FROM clustered WHERE cluster IS NOT NULL GROUP BY ALL)
            SELECT n.cluster, chr(65 + n.cluster) AS label, 'Cluster ' || chr(65 + n.cluster) AS title,
                   coalesce(c.image, '') AS image, n.weight FROM counts n LEFT JOIN covers c ON c.cluster = n.cluster""",
        "network_payload": f"""WITH {GLOBAL}, {SONGS}, {representatives()}
            SELECT 'node' AS kind, NULL::INTEGER AS prev_cluster, n.cluster, chr(65 + n.cluster) AS label,
                   'Cluster ' || chr(65 + n.cluster) AS title, coalesce(c.image, '') AS image, n.weight
            FROM (SELECT cluster, count(*) AS weight FROM sessions WHERE cluster IS NOT NULL GROUP BY ALL) n
            LEFT JOIN covers c ON c.cluster = n.cluster
            UNION ALL SELECT 'edge', prev_cluster, cluster, NULL, NULL, NULL, count(*) FROM sessions
            WHERE ses_len > 1 AND prev_cluster IS NOT NULL AND cluster IS NOT NULL GROUP BY prev_cluster, cluster""",
        "network_payload_month": f"""WITH {GLOBAL}, {SONGS}, {representatives(month_per_play)}, ends AS (
            SELECT year, month, cluster, 1 AS w FROM sessions WHERE cluster IS NOT NULL
            UNION ALL SELECT DISTINCT year, month, prev_cluster, 0 FROM sessions
            WHERE ses_len > 1 AND prev_cluster IS NOT NULL AND cluster IS NOT NULL)
            SELECT n.year, n.month, 'node' AS kind, NULL::INTEGER AS prev_cluster, n.cluster, chr(65 + n.cluster) AS label,
                   'Cluster ' || chr(65 + n.cluster) AS title, coalesce(c.image, '') AS image, n.weight
            FROM (SELECT year, month, cluster, CAST(sum(w) AS BIGINT) AS weight FROM ends GROUP BY ALL) n
            LEFT JOIN covers c ON c.cluster = n.cluster AND c.year = n.year AND c.month = n.month
            UNION ALL SELECT year, month, 'edge', prev_cluster, cluster, NULL, NULL, NULL, count(*) FROM sessions
            WHERE ses_len > 1 AND prev_cluster IS NOT NULL AND cluster IS NOT NULL GROUP BY year, month, prev_cluster, cluster""",
        "cluster_cover_month": f"WITH {EXPANDED}, {SONGS}, {representatives(month_per_play)} SELECT year, month, cluster, cluster_label, "
        "id, song, artist, image FROM covers",
        "kmeans_fit": f"SELECT CAST(range AS INTEGER) AS cluster, chr(65 + CAST(range AS INTEGER)) AS cluster_label, TRUE AS is_mean, "
        f"TRUE AS in_order FROM range({DEFAULTS.n_clusters})",
        "kmeans_model_roundtrip": "SELECT vec_id AS id, TRUE AS same FROM embeddings",
        "assign_clusters": "SELECT vec_id AS g_id, TRUE AS is_nearest, TRUE AS labelled FROM embeddings",
        "similarity_graph": "SELECT vec_id AS id, least(10, (SELECT count(*) FROM embeddings) - 1) AS n_neighbours, "
        "TRUE AS weights_right FROM embeddings",
        "spectral_clusters": "SELECT vec_id AS id, TRUE AS as_it_should FROM embeddings",
        "big5_month": f"WITH {EXPANDED}, {traits_sql()} SELECT {day('date')} AS date, {r6('logit')} AS logit, trait, trait_short, "
        f"trait_pos, trait_neg, trait_desc, {r6('score')} AS score, {r6('score_pct')} AS score_pct FROM monthly",
        "big5_overall": f"""WITH {EXPANDED}, {traits_sql()}, overall AS (
            SELECT trait_short, trait, trait_pos, trait_neg, avg(score) AS s FROM monthly GROUP BY ALL)
            SELECT trait_short, trait, trait_pos, trait_neg, {r6("s")} AS score,
                   CASE WHEN s >= 0 THEN trait_pos ELSE trait_neg END AS trait_desc, {r6("abs(s) * 100")} AS score_pct FROM overall""",
        "latent_distance_month": f"""WITH {GLOBAL}, steps AS (
            SELECT s.year, s.month, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),
                   lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
            FROM sessions s JOIN embeddings a ON a.vec_id = s.prev_g_id JOIN embeddings b ON b.vec_id = s.g_id)
            SELECT year, month, {r6("avg(d)")} AS latent_dist_mean, count(*) AS n_steps,
                   {day("make_date(year, month, 1)")} AS date FROM steps GROUP BY year, month""",
        "centroids": f"WITH {MEANS} SELECT cluster, cluster_label, {vector_text('centroid')} AS centroid FROM centroids",
        "centroid_distance": f"WITH {DISTANCES} SELECT g_id, cluster, cluster_label, {r6('centroid_dist')} AS centroid_dist FROM distances",
        "representative_songs": f"WITH {EXPANDED}, {SONGS}, {representatives()} SELECT cluster, cluster_label, id, "
        f"{r6('centroid_dist')} AS centroid_dist, song, artist, album FROM examples",
        "representative_songs_month": f"WITH {EXPANDED}, {SONGS}, {representatives(month_per_play)} SELECT year, month, cluster, "
        f"cluster_label, id, {r6('centroid_dist')} AS centroid_dist, song, artist, album FROM examples",
        "representative_songs_within_month": f"""WITH {EXPANDED}, {SONGS}, {DISTANCES}, heard AS (
            SELECT DISTINCT p.year, p.month, d.* FROM expanded p JOIN distances d ON d.g_id = p.g_id),
            ranked AS (SELECT *, dense_rank() OVER (PARTITION BY year, month, cluster ORDER BY centroid_dist) AS r FROM heard)
            SELECT year, month, cluster, d.cluster_label, d.g_id AS id, {r6("d.centroid_dist")} AS centroid_dist, p.song, p.artist, p.album
            FROM ranked d JOIN expanded p USING (year, month, g_id) WHERE d.r <= 3 AND d.g_id IN (SELECT id FROM songs)
            QUALIFY row_number() OVER (PARTITION BY year, month, cluster, d.g_id ORDER BY dt, source, play_id, song, artist, album) = 1""",
        "cluster_cover": f"WITH {EXPANDED}, {SONGS}, {representatives()} SELECT cluster, cluster_label, id, song, artist, image FROM covers",
        "image_url": f"WITH {SONGS} SELECT id, image FROM images",
        "image_from_json": f"WITH {SONGS} SELECT id, url AS image FROM songs",
        "song_metadata": f"WITH {SONGS} SELECT title AS search, 0 AS rank, title AS song, artist, album, release_date, url FROM songs",
        "query_prompt": "SELECT doc_id, md5('task: search result | query: ' || replace(text, '|', '')) AS prompt_md5 FROM documents",
        "normalize_vectors": "WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], "
        f"embedding::DOUBLE[])) AS norm FROM embeddings) SELECT id, {vector_text('list_transform(v, lambda y: y / norm)')} AS unit FROM n",
        "normalize_query_compat": f"""WITH elements AS (
            SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
            norms AS (SELECT pos, sqrt(sum(x * x)) AS norm FROM elements GROUP BY pos),
            scaled AS (SELECT id, list(x / nullif(norm, 0) ORDER BY pos) AS v FROM elements JOIN norms USING (pos) GROUP BY id)
            SELECT id, {vector_text("v")} AS scaled FROM scaled""",
        "search_table": f"SELECT vec_id AS id, {vector_text('embedding')} AS embedding FROM embeddings",
        "vector_search": f"WITH {hits(5)} SELECT search_num, rank, id, {r6('dist')} AS dist FROM hits",
        "vector_search_blocks": f"WITH {hits(5)} SELECT search_num, rank, id, {r6('dist')} AS dist FROM hits",
        "vector_search_zero": f"""WITH {hits(5, "CASE WHEN vec_id % 5 = 0 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) "
            "ELSE embedding::DOUBLE[] END")} SELECT search_num, rank, id, {r6('dist')} AS dist FROM hits""",
        "search_bounded": f"WITH {hits(20)} SELECT search_num, rank, id, {r6('dist')} AS dist FROM hits WHERE dist >= 0.3 AND dist <= 0.4",
        "embed_texts": f"WITH docs AS (SELECT doc_id AS id, text FROM documents), {hashed('docs', 'corpus')} "
        f"SELECT id, {vector_text('v')} AS embedding FROM corpus",
        "text_search": f"WITH {TEXT_HITS} SELECT search_num, rank, id, {r6('dist')} AS dist FROM hits",
        "search_metadata": f"""WITH {TEXT_HITS}, {SONGS} SELECT b.text AS "Search", h.rank AS "Rank", s.title AS "Song",
            s.artist AS "Artist", s.album AS "Album", s.release_date AS "Release Date", s.url AS "Url"
            FROM hits h JOIN benchmark b ON b.item_id = h.search_num JOIN songs s ON s.id = h.id""",
    }
