"""The exact vector operators in DuckDB's SQL: a full search in every round."""

from __future__ import annotations

from playlytics.llm import centroids, vector_codes

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR_MEAN = "((total - ((total % n) + n) % n) // n)"


def _floors(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)"


def _distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _centroid_rounds() -> str:
    steps = []
    for k in range(centroids.ROUNDS + 1):
        steps.append(f"""
found{k} AS MATERIALIZED (
  SELECT r, v, min((distance, cluster)) AS best
  FROM (SELECT r, i.v, cluster, {_distance("i.v", "c.v")} AS distance FROM ints i, centers{k} c) GROUP BY r, v)""")
        if k < centroids.ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT cluster, list({_FLOOR_MEAN}::BIGINT ORDER BY place) AS v
  FROM (SELECT cluster, place, sum(x) AS total, count(*) AS n
        FROM (SELECT best[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM found{k}) GROUP BY cluster, place)
  GROUP BY cluster),
centers{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM centers{k} c LEFT JOIN means{k} m USING (cluster))""")
    return ",".join(steps)


CENTROIDS = f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {_floors(centroids.SCALE)} AS v
  FROM embeddings WHERE len(embedding) = {centroids.WIDTH} AND {_FINITE}),
centers0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SALT}' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster, v
  FROM ints QUALIFY cluster < {centroids.CLUSTERS}),{_centroid_rounds()}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance,
       (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM found{centroids.ROUNDS} JOIN ints USING (r) JOIN centers{centroids.ROUNDS} c ON c.cluster = best[2]
"""


def _code_rounds() -> str:
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
found{k} AS MATERIALIZED (
  SELECT r, part, any_value(x) AS x, min((distance, entry)) AS best
  FROM (SELECT r, part, p.v AS x, entry, {_distance("p.v", "c.v")} AS distance FROM parts p JOIN books{k} c USING (part))
  GROUP BY r, part)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
means{k} AS (
  SELECT part, entry, list({_FLOOR_MEAN}::BIGINT ORDER BY place) AS v
  FROM (SELECT part, entry, place, sum(y) AS total, count(*) AS n
        FROM (SELECT part, best[2] AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM found{k})
        GROUP BY part, entry, place)
  GROUP BY part, entry),
books{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, c.v) AS v FROM books{k} c LEFT JOIN means{k} m USING (part, entry))""")
    return ",".join(steps)


CODES = f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, {_floors(vector_codes.SCALE)} AS v
  FROM embeddings WHERE len(embedding) > 0 AND {_FINITE}),
parts AS MATERIALIZED (
  SELECT r, part, v[part * len(v) // {vector_codes.PARTS} + 1 : (part + 1) * len(v) // {vector_codes.PARTS}] AS v
  FROM ints, range({vector_codes.PARTS}) AS p(part)),
first AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM ints QUALIFY entry < {vector_codes.ENTRIES}),
books0 AS MATERIALIZED (SELECT part, entry, v FROM first JOIN parts USING (r)),{_code_rounds()},
coded AS (
  SELECT r, string_agg(lpad(to_hex(best[2]), 2, '0'), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error
  FROM found{vector_codes.ROUNDS} GROUP BY r)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM books{vector_codes.ROUNDS}) AS codebooks_sha256
FROM coded JOIN ints USING (r)
"""
