"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from plumbline.llm import linededup, quality

_BOILER = "|".join(quality.BOILERPLATE).replace("'", "''")
_LINK = "^(" + "|".join(quality.LINK_STARTS).replace(".", "[.]") + ")"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
),
win AS (
  SELECT r, unnest(generate_series(1, len(ws) - {quality.WINDOW - 1})) AS i FROM w WHERE len(ws) >= {quality.WINDOW}
),
grams AS (
  SELECT win.r, i, array_to_string(list_slice(ws, i, i + {quality.WINDOW - 1}), ' ') AS g FROM win JOIN w USING (r)
),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, {quality.WINDOW - 1})) AS k) GROUP BY r
),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM d
),
facts AS (
  SELECT r, k, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth,
    regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[!-/:-@\[-`{{-~]')) AS marks
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
counted AS (
  SELECT *, len(list_filter(ws, lambda x: regexp_matches(x, '(!!|\?\?)$'))) AS shouts,
    len(list_filter(ws, lambda x: x IN ('|', '>', '/', '-', '»', '•', '·'))) AS seps,
    len(list_filter(ws, lambda x: regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LINK}'))) AS links
  FROM facts
),
ruled AS (
  SELECT *, marks >= {quality.PUNCT_MARKS} AND 100 * marks > {quality.PUNCT_PERCENT} * chars
    OR shouts >= {quality.SHOUTS} AND 100 * shouts > {quality.SHOUT_PERCENT} * len(ws)
    OR seps >= {quality.SEPARATORS} AND 100 * seps > {quality.SEPARATOR_PERCENT} * len(ws)
    OR links >= {quality.LINKS} AND 100 * links > {quality.LINK_PERCENT} * len(ws)
    OR len(ws) <= {quality.BOILERPLATE_WORDS}
       AND regexp_matches(lower(line), '{_BOILER}') AS failed
  FROM counted
),
per AS (
  SELECT r, count(*) AS n_lines, sum(failed::INT) AS n_failed_lines, sum(CASE WHEN failed THEN chars ELSE 0 END) AS failed_chars,
    sum(chars) AS chars, sum((nth > 1)::INT) AS dups
  FROM ruled GROUP BY r
),
base AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(per.chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(failed_chars, 0) AS failed_chars
  FROM d JOIN w USING (r) LEFT JOIN per USING (r) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words)
    AND 100 * failed_chars <= {quality.LOST_PERCENT} * word_chars AS kept,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, failed_chars::BIGINT AS failed_chars
FROM base
"""

OP2 = r"""
WITH b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
),
pat AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS g
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)
),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
g AS (
  SELECT r, i, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g
  FROM (SELECT r, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i
        FROM d, (SELECT DISTINCT m FROM pat) WHERE len(ws) >= m)
),
hit AS (SELECT g.r, g.i, g.m, pat.item FROM g JOIN pat ON pat.g = g.g AND pat.m = g.m),
words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r
),
items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: crc32 of UTF-8 text, bit by bit over a table of 256 entries that the query makes itself.
_CRC = """
poly(k, c) AS (
  SELECT range::BIGINT, list_reduce(list_prepend(range::BIGINT, generate_series(1, 8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM range(256)
),
tab AS (SELECT list(c ORDER BY k) AS t FROM poly)
"""

OP3 = f"""
WITH RECURSIVE {_CRC},
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
),
crc AS (
  SELECT r, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS text_crc32
  FROM d, tab
),
jump(doc_id, n, state, shard, ahead) AS (
  SELECT DISTINCT doc_id, n, CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END,
    -1::BIGINT, 0::BIGINT FROM d, (VALUES (8), (9)) AS v(n)
  UNION ALL
  SELECT doc_id, n, next, ahead, floor((ahead + 1)::DOUBLE * (2147483648::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE ahead < n)
),
put AS (SELECT doc_id, n, shard FROM jump WHERE ahead >= n),
placed AS (
  SELECT d.r, d.doc_id, (octet_length(encode(d.text)) + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, a.shard::INT AS shard, b.shard::INT AS grown_shard
  FROM d JOIN crc USING (r)
  JOIN put a ON a.doc_id IS NOT DISTINCT FROM d.doc_id AND a.n = 8
  JOIN put b ON b.doc_id IS NOT DISTINCT FROM d.doc_id AND b.n = 9
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM placed
"""

ORACLES = {"op1_line_quality": OP1, "op2_wu_manber": OP2, "op3_jump_shards": OP3}

#: White space inside a line, and blocks of just enough words that start or end at a line. Equal rows are one document.
OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text, n FROM (SELECT doc_id, text, count(*) AS n FROM documents GROUP BY ALL)
),
l AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0b\f\r]')) AS lines FROM d WHERE text IS NOT NULL
),
t AS (
  SELECT r, lines, list_transform(lines, lambda x: regexp_replace(x, '^[ \t\x0b\f\r]+|[ \t\x0b\f\r]+$', '', 'g')) AS own FROM l
),
one AS (
  SELECT r, unnest(generate_series(1, len(own))) AS p, unnest(own) AS line FROM t
),
n AS (
  SELECT r, p, len(regexp_extract_all(line, '[^ \t\x0b\f\r]+')) AS n FROM one
),
s AS (SELECT r, p, n, sum(n) OVER (PARTITION BY r ORDER BY p) AS ends FROM n),
forth AS (
  SELECT a.r, a.p AS start, min(b.p) AS stop FROM s a JOIN s b ON a.r = b.r AND b.p >= a.p AND b.p < a.p + {linededup.MIN_WORDS} AND b.ends - a.ends + a.n >= {linededup.MIN_WORDS} GROUP BY 1, 2
),
back AS (
  SELECT a.r, max(b.p) AS start, a.p AS stop FROM s a JOIN s b ON a.r = b.r AND b.p <= a.p AND b.p > a.p - {linededup.MIN_WORDS} AND a.ends - b.ends + b.n >= {linededup.MIN_WORDS} GROUP BY a.r, a.p
),
block AS (
  SELECT r, start, stop, sha256(array_to_string(list_slice(own, start, stop), chr(10))) AS body
  FROM (SELECT * FROM forth UNION SELECT * FROM back) JOIN t USING (r)
),
later AS (
  SELECT r, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY r, start) AS k FROM block) WHERE k > 1
),
gone AS (
  SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(generate_series(start, stop)) AS p FROM later) GROUP BY r
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed_lines,
  CASE WHEN ps IS NULL THEN text
    ELSE coalesce(array_to_string(list_filter(list_transform(generate_series(1, len(lines)), lambda i: CASE WHEN list_contains(ps, i) THEN NULL ELSE lines[i] END), lambda x: x IS NOT NULL), chr(10)), '') END AS text
FROM d LEFT JOIN l USING (r) LEFT JOIN gone USING (r), (SELECT unnest(generate_series(1, (SELECT max(n) FROM d))) AS k) WHERE k <= n
"""

ORACLES["op8_line_runs"] = OP8


def _round(r: int, dims: int = 64) -> str:
    """Assignment ``a<r>`` to the centroids ``c<r>``, and the centroids ``c<r + 1>``; sums are floored downwards."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT r, (min(row(d, j))).d AS distance, (min(row(d, j))).j AS cluster FROM (
    SELECT v.r, c.j, list_sum(list_transform(generate_series(1, {dims}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v, c{r} c
  ) GROUP BY r
),
s{r} AS (SELECT cluster, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (r), (SELECT unnest(generate_series(1, {dims})) AS i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY cluster) m ON m.cluster = c.j
)""".replace("row(d, j)", "{'d': d, 'j': j}")


OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, 'null')) AS h, x FROM v ORDER BY h, x LIMIT 8)
),
{",".join(_round(r) for r in range(11))},
total AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia, (SELECT sum(distance) FROM a10)::BIGINT AS inertia FROM a10 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN v USING (r) JOIN total USING (cluster) JOIN c10 ON c10.j = a10.cluster
"""

OP12 = rf"""
WITH {_CRC},
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM words, tab
),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket)
),
weights AS (
  SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r
),
scored AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS nth, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * n // 100 THEN nth END::BIGINT AS rank FROM scored LEFT JOIN placed USING (r)
"""

ORACLES |= {"op11_drake_bounds": OP11, "op12_target_draw": OP12}

#: A byte goes if one of the 50 strings that cover it starts in a document of a smaller id; null ids stand last.
OP13 = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
),
p AS (SELECT r, k, unnest(bytes) AS b, unnest(generate_series(1, len(bytes))) AS i FROM d),
w AS MATERIALIZED (
  SELECT r, k, i, b, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(b, '') OVER ahead END AS s
  FROM p WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
f AS (SELECT s, min(k) AS k FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(k) < max(k)),
g AS (SELECT w.r, w.i, w.b, CASE WHEN f.k < w.k THEN w.i END AS gone FROM w LEFT JOIN f USING (s)),
c AS (SELECT r, i, b, coalesce(max(gone) OVER (PARTITION BY r ORDER BY i) >= i - 49, false) AS covered FROM g),
e AS (SELECT *, covered AND NOT coalesce(lag(covered) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c),
t AS (
  SELECT r, count(*) AS n, sum(covered::INT) AS n_removed, sum(opens::INT) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT covered), ''))) AS kept FROM e GROUP BY r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(kept, sha256('')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""

ORACLES["op13_column_bwt"] = OP13
