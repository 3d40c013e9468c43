"""DuckDB SQL for the queries that SQL can state."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
x AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
),
h AS (SELECT r, i, n, item_id FROM x JOIN g USING (n, gram)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, line, pos, trim(line, chr(32) || chr(9) || chr(13)) AS t
  FROM (SELECT r, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d)),
n AS (SELECT source, count(*) AS total FROM d GROUP BY source),
p AS (SELECT source, t, count(DISTINCT r) AS pages FROM l WHERE t <> '' GROUP BY source, t),
b AS (SELECT p.source, p.t FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source WHERE pages >= 5 AND pages > 0.1::DOUBLE * total),
k AS (SELECT l.*, b.t IS NOT NULL AS gone FROM l LEFT JOIN b ON l.t = b.t AND l.source IS NOT DISTINCT FROM b.source),
s AS (SELECT r, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256 FROM d JOIN s USING (r)
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, md5_number(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS s FROM d)),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
b AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 200, true) AS opens FROM w JOIN t USING (k)),
n AS (SELECT r, s, sum(opens::INT) OVER (PARTITION BY r ORDER BY s) AS span FROM b),
p AS (SELECT r, min(s) AS x, max(s) + 200 AS y FROM n GROUP BY r, span),
q AS (SELECT r, x, y, lag(y, 1, 0) OVER (PARTITION BY r ORDER BY x) AS z FROM p),
c AS (SELECT r, sum(y - x) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (x - z)), '' ORDER BY x) || substr(any_value(h), 2 * max(y) + 1) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * words AS most FROM s),
o AS (SELECT *, most / weight AS full_at FROM w),
l AS (
  SELECT full_at, (sum(words) OVER () - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o
),
t AS (SELECT source, rank, words::BIGINT AS words, least(most, (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * weight) AS target FROM o),
a AS (
  SELECT doc_id, size, words, target, floor(target + 0.5)::BIGINT AS due, [-0.5, 0.0, 0.5][(rank % 3 + 1)::INT]::DOUBLE AS ramp,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
k AS (SELECT *, (CASE WHEN size > 0 THEN (due > begun)::INT + (due - words > begun)::INT + (due - 2 * words > begun)::INT ELSE 0 END)::BIGINT AS copies FROM a),
y AS (SELECT *, begun / due::DOUBLE AS y1, ((copies - 1) * words + begun) / due::DOUBLE AS y2 FROM k)
SELECT doc_id, size, words AS source_size, target,
  (greatest(0, least(size, due - begun)) + greatest(0, least(size, due - words - begun)) + greatest(0, least(size, due - 2 * words - begun)))::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE WHEN ramp = 0 THEN y1 ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y1) - (1 - ramp)) / (2 * ramp) END, 9) + 0 END AS first_position,
  CASE WHEN copies > 0 THEN round(CASE WHEN ramp = 0 THEN y2 ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y2) - (1 - ramp)) / (2 * ramp) END, 9) + 0 END AS last_position
FROM y
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, min(doc_id) AS least FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, least(doc_id, coalesce(c.least, doc_id)) = doc_id AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c ON c.a = d.r
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op2_line_dedup": OP2,
    "op4_embedding_dedup": OP4,
    "op5_substring_dedup": OP5,
    "op8_warc": OP8,
    "op9_mixing": OP9,
    "op10_minhash": OP10,
}
