"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from vectrail.llm import quality

SPACE = r"\x20\x09-\x0D"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^{SPACE}]+') AS ws FROM d),
g AS (SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
inside AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS s(k) GROUP BY id),
l0 AS (SELECT id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT id, host, t, line, len(regexp_extract_all(line, '[^{SPACE}]+')) AS n, array_to_string(regexp_extract_all(translate(lower(line), '0123456789', '0000000000'), '[^{SPACE}]+'), ' ') AS plain FROM l0 WHERE regexp_matches(line, '[^{SPACE}]')),
dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY id),
hosts AS (SELECT host, count(DISTINCT t) AS of FROM d GROUP BY host),
often AS (SELECT host, plain, count(DISTINCT t) AS n_docs FROM l GROUP BY host, plain),
limited AS (SELECT o.host, plain FROM often o JOIN hosts h ON h.host = o.host WHERE n_docs > {quality.HOST_DOCS} AND n_docs > {quality.HOST_SHARE}::DOUBLE * of),
gone AS (SELECT id, sum(n)::BIGINT AS n_removed_words FROM l JOIN limited m ON m.host = l.host AND m.plain = l.plain GROUP BY id),
c AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
 FROM d JOIN w ON w.id = d.id LEFT JOIN dup ON dup.id = d.id LEFT JOIN inside ON inside.id = d.id LEFT JOIN gone ON gone.id = d.id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, NOT base_failed AND n_words - n_removed_words >= {quality.LEFT_WORDS} AND n_words - n_removed_words >= {quality.LEFT_SHARE}::DOUBLE * n_words AS kept FROM b"""

TOP_K = """WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row, vec_id, list_transform(x, lambda y: floor(256 * y)) AS v FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, coalesce(list_dot_product(q.v, c.v), 0)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5"""

WARC = """WITH p AS (SELECT row_number() OVER () AS row, page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT row, page_id, url, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, row) AS n, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, row) AS held_by FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN held_by END AS refers_to FROM o"""

NEGATIVES = """WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row, vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS v FROM e WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS (SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_dot_product(a.v, c.v), 0)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS turn FROM p WHERE same) WHERE turn <= 5),
n AS (SELECT g.anchor_id, g.vec_id AS positive_id, p.vec_id AS negative_id, g.score AS positive_score, p.score AS negative_score, row_number() OVER (PARTITION BY g.row, g.turn ORDER BY p.score DESC, p.vec_id) AS rank
 FROM g JOIN p ON p.row = g.row AND NOT p.same AND 100 * p.score BETWEEN 30 * g.score AND 90 * g.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

SQL = {"op4_quality_rules": QUALITY, "op5_exact_topk": TOP_K, "op6_warc": WARC, "op11_hard_negatives": NEGATIVES}
