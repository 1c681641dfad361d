"""The results of registered queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from playlytics.llm import licenses, urls
from playlytics.llm.oracles_vectors import CENTROIDS, CODES
from playlytics.llm.sharding import SHARDS, SLOTS, fill

_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACE_WORD}')), 0) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS turn
  FROM docs GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][turn + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM sources),
-- filled from the sources with the least room for their weight: the first level that fits all the others
levels AS (
  SELECT most / weight AS room, row_number() OVER (ORDER BY most / weight, source) AS k,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
level AS (SELECT arg_min(level, k) AS level FROM levels WHERE room >= level),
targets AS (
  SELECT source, source_size, turn, least(most, weight * level) AS target,
         floor(least(most, weight * level) + 0.5)::BIGINT AS budget
  FROM weighed, level),
placed AS (
  SELECT d.*, t.source_size, t.turn, t.target, t.budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, budget - start)) AS one, greatest(0, least(size, budget - start - source_size)) AS two,
         start::DOUBLE / budget AS spent
  FROM placed),
spends AS (SELECT *, spent * [3.0, 1.0, 2.0][turn + 1]::DOUBLE AS y FROM taken)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 OR (size = 0 AND start < budget) THEN
    CASE WHEN turn = 0 THEN CASE WHEN y > 0 THEN 2 * y / (4.5 + sqrt(20.25 + 2 * -3.0::DOUBLE * y)) ELSE 0 END
         WHEN turn = 1 THEN CASE WHEN y > 0 THEN 2 * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE)) ELSE 0 END
         WHEN y < 0.75 THEN CASE WHEN y > 0 THEN 2 * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 4.0 * y)) ELSE 0 END
         ELSE 0.5::DOUBLE + CASE WHEN y > 0.75 THEN 2 * (y - 0.75) / (2.0::DOUBLE + sqrt(4.0::DOUBLE + 4.0 * (y - 0.75))) ELSE 0 END
    END END AS position
FROM spends
"""

SHARDING = f"""
WITH placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(({fill(SHARDS, SLOTS)}[slot + 1])::VARCHAR, 3, '0') AS shard FROM placed
"""

DECONTAMINATION = rf"""
WITH item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS run
  FROM (SELECT item, r, w, unnest(range(greatest(0, len(w) - 9) + CASE WHEN len(w) BETWEEN 1 AND 9 THEN 1 ELSE 0 END)) AS i
        FROM item_words)),
docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM docs),
hits AS (
  SELECT p.r, p.i, x.size, x.item
  FROM places p CROSS JOIN (SELECT DISTINCT size FROM windows) s
  JOIN windows x ON x.size = s.size AND p.i + s.size <= len(p.w) AND array_to_string(p.w[p.i + 1 : p.i + s.size], ' ') = x.run),
hit_words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def _values(rows: list[tuple]) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)


_RULES = _values([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in urls.RULES])

URL_FILTER = rf"""
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES}),
terms(term, weight) AS (VALUES {_values(list(urls.TERMS.items()))}),
pages_read AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(url_decode(coalesce(url, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS decoded
  FROM pages),
parts AS (
  SELECT *, regexp_extract(low, '^(?s:.*?)://([^/?#]*)', 1) AS host, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages_read),
fitting AS (
  SELECT r, arg_min(struct_pack(rule := rule, verdict := verdict), (-length(rule), rule)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r),
weights AS (
  SELECT r, sum(weight)::DOUBLE AS weight FROM pages_read JOIN terms
    ON regexp_matches(decoded, '(^|[^0-9a-z])' || term || '([^0-9a-z]|$)') GROUP BY r)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN coalesce(weight, 0) >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(weight, 0) AS weight
FROM parts LEFT JOIN fitting USING (r) LEFT JOIN weights USING (r)
"""

_SHINGLES = _values(
    [
        (t, len(licenses.words_of(text)), licenses.shingle_words(len(licenses.words_of(text))), len(licenses.template_shingles(text)), s)
        for t, text in licenses.TEMPLATES.items()
        for s in licenses.template_shingles(text)
    ]
)

LICENSES = rf"""
WITH known(template, n, length, total, shingle) AS (VALUES {_SHINGLES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
runs AS (
  SELECT r, doc_id, length, len(w) - length + 1 AS size, i, array_to_string(w[i + 1 : i + length], ' ') AS shingle
  FROM (SELECT *, unnest(range(len(w) - length + 1)) AS i FROM docs JOIN (SELECT DISTINCT length FROM known) ON len(w) >= length)),
places AS (
  SELECT r, doc_id, size, i, template, n, total, shingle, greatest(1, n // 2) AS stride, n + greatest(1, n // 2) - length + 1 AS width
  FROM runs JOIN known USING (length, shingle)),
windows AS (  -- window k holds the runs from k * stride on; the last one reaches the end
  SELECT *, unnest(range(greatest(0, (i - width + stride) // stride),
                         least(i // stride, (greatest(0, size - width) + stride - 1) // stride) + 1)) AS k
  FROM places),
shares AS (
  SELECT r, doc_id, template, k * stride AS first, count(DISTINCT shingle) / total AS containment
  FROM windows WHERE i >= k * stride AND i < k * stride + width
  GROUP BY r, doc_id, template, total, stride, k)
SELECT doc_id, template, max(containment)::DOUBLE AS containment,
       arg_min(first, (-containment, first))::BIGINT AS first_word
FROM shares WHERE containment >= {licenses.CONTAINED} - 1e-9 GROUP BY doc_id, template
"""

_QUOTED = r"^\s*>"


def _normal(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'))"


CHAT = rf"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS r, *, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
owned AS (
  SELECT *, trim(array_to_string(list_filter(lines, lambda x, i: NOT regexp_matches(x, '{_QUOTED}') AND NOT (
           regexp_matches(x, '(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$')
           AND coalesce(regexp_matches(lines[i + 1], '{_QUOTED}'), FALSE))), chr(10)), ' ' || chr(9) || chr(13) || chr(10)) AS own
  FROM messages),
quoted AS (
  SELECT r, conv_id, turn, i, regexp_replace(line, '^(\s*>)+', '') AS line,
         length(regexp_replace(regexp_extract(line, '^(\s*>)+'), '[^>]', '', 'g')) AS level
  FROM (SELECT r, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM messages)
  WHERE regexp_matches(line, '{_QUOTED}') AND conv_id IS NOT NULL AND turn IS NOT NULL),
passages AS (
  SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i) AS line
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM quoted) GROUP BY r, conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i) AS line
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, level ORDER BY i) AS run FROM quoted WHERE {_normal("line")} <> '')
  GROUP BY r, conv_id, turn, level, run
  UNION ALL SELECT conv_id, turn, level, line FROM quoted),
asked AS (SELECT DISTINCT conv_id, turn, level, {_normal("line")} AS unit FROM passages),
stated AS (
  SELECT conv_id, {_normal("part")} AS unit, min(turn) AS first
  FROM (SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\n\s*\n'), regexp_split_to_array(own, '\n'))) AS part
        FROM owned) GROUP BY ALL),
votes AS (
  SELECT a.conv_id, turn, level, first, sum(len(string_split(unit, ' '))) AS words
  FROM asked a JOIN stated s USING (conv_id, unit) WHERE unit <> '' AND first < turn GROUP BY ALL),
replies AS (SELECT conv_id, turn, arg_min(first, (level, -words, -first)) AS up FROM votes GROUP BY ALL),
chains AS (
  SELECT conv_id, turn, up, 1 AS depth FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.up, c.depth + 1 FROM chains c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.up),
threads AS (
  SELECT conv_id, turn, arg_max(up, depth) AS thread, arg_min(up, depth) AS reply_to, max(depth) AS depth FROM chains GROUP BY ALL)
SELECT m.conv_id, coalesce(t.thread, m.turn) AS thread, m.turn, role, coalesce(t.depth, 0) AS depth, reply_to,
       len(list_filter(lines, lambda x: regexp_matches(x, '{_QUOTED}'))) AS n_quoted, own AS text,
       '<|' || coalesce(role, '') || '|>' || chr(10) || own || chr(10) || '<|end|>' AS formatted
FROM owned m LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""

ORACLES = {
    "op1_mixing": MIXING,
    "op2_sharding": SHARDING,
    "op5_url_filter": URL_FILTER,
    "op8_licenses": LICENSES,
    "op9_decontamination": DECONTAMINATION,
    "op10_chat": CHAT,
    "op12_centroids": CENTROIDS,
    "op13_codes": CODES,
}
