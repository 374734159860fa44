"""DuckDB SQL of the corpus queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (g) WHERE doc_id > m),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
win AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, size, i FROM win JOIN items USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, size, i, md5(array_to_string(w[i:i + size - 1], ' ')) AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (VALUES (5), (15), (51)) AS s(size) WHERE len(w) >= size)),
twice AS (SELECT r, size, g FROM win GROUP BY r, size, g HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, size, unnest(range(i, i + size)) AS p FROM win JOIN twice USING (r, size, g)),
n AS (SELECT r, count(*) FILTER (size = 5) AS fives, count(*) FILTER (size = 15) AS covered, max(size) AS longest FROM hit GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(fives, 0) AS n_repeat_words, coalesce(covered, 0) AS n_covered_words, coalesce(longest, 0) AS longest
  FROM d LEFT JOIN n USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_covered_words <= 10 * n_words AND longest < 51 AS kept
FROM m
"""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#mix') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 150 / 100::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source ASC NULLS LAST)),
pick AS (SELECT arg_min(level, most / weight) AS level FROM l WHERE level * weight <= most),
goal AS (SELECT source, source_size, budget, least(most, coalesce((SELECT level FROM pick) * weight, most)) AS target FROM l),
q AS (
  SELECT d.*, source_size, target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN goal ON goal.source IS NOT DISTINCT FROM d.source),
c AS (
  SELECT r, budget, sum(size) OVER (ORDER BY (epoch * source_size + upto)::DOUBLE / target, h, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS total
  FROM q, (VALUES (0), (1)) AS e(epoch) WHERE size > 0),
n AS (SELECT r, count(*) AS copies FROM c WHERE total <= budget GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(copies, 0) * size AS taken FROM q LEFT JOIN n USING (r)
"""

OP8 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p),
b AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM j),
h AS (SELECT host, count(by_rule) AS n, count(*) FILTER (by_rule = 'allow') AS good, array_to_string(string_split(host, '.')[-2:], '.') AS two, string_split(host, '.')[-1] AS one, array_to_string(string_split(host, '.')[-3:], '.') AS three FROM b GROUP BY host),
k AS (SELECT *, regexp_full_match(two, '(ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|or|org)\.[a-z]{2}') AS deep FROM h),
hosts AS (SELECT host, n, good, CASE WHEN deep THEN two ELSE one END AS suffix, CASE WHEN deep THEN three ELSE two END AS domain FROM k),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix),
units AS (SELECT 1 AS lv, n::DOUBLE AS n, good::DOUBLE AS g FROM hosts UNION ALL SELECT 2, n::DOUBLE, good::DOUBLE FROM domains UNION ALL SELECT 3, n::DOUBLE, good::DOUBLE FROM suffixes),
sums AS (SELECT lv, sum(n) AS n, sum(g) AS g, sum(g * g / n) AS gg, sum(n * n) AS nn, count(*) AS k FROM units WHERE n > 0 GROUP BY lv),
moments AS (SELECT *, g / n AS p, g / n * (1 - g / n) AS within, n - nn / n - (k - 1) AS room FROM sums),
rhos AS (SELECT *, CASE WHEN within > 0 AND room > 0 THEN (gg - n * p * p - within * (k - 1)) / (within * room) END AS rho FROM moments),
strengths AS (SELECT lv, (g + 1) / (n + 2) AS overall, CASE WHEN rho IS NULL THEN 1.0 WHEN rho <= 1.0 / 1001 THEN 1000.0 ELSE greatest(1.0, 1 / rho - 1) END AS s FROM rhos),
v AS (
  SELECT coalesce((SELECT overall FROM strengths WHERE lv = 3), 0.5) AS overall, coalesce((SELECT s FROM strengths WHERE lv = 1), 1.0) AS s1, coalesce((SELECT s FROM strengths WHERE lv = 2), 1.0) AS s2,
    coalesce((SELECT s FROM strengths WHERE lv = 3), 1.0) AS s3),
by_suffix AS (SELECT suffix, (good + s3 * overall) / (n + s3) AS mean FROM suffixes, v),
by_domain AS (SELECT domain, (good + s2 * mean) / (n + s2) AS mean FROM domains JOIN by_suffix USING (suffix), v),
post AS (SELECT host, good + s1 * mean AS a, n - good + s1 * (1 - mean) AS b FROM hosts JOIN by_domain USING (domain), v),
bound AS (SELECT host, a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper FROM post)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN bound USING (host)
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY hex),
r AS (SELECT page_id, strlen(html) AS payload_bytes, hex, CASE WHEN n > 1 AND (page_id > first_id OR page_id IS NULL) THEN first_id END AS refers_to FROM p JOIN g USING (hex))
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
ends AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, x AS root FROM ends UNION SELECT y, root FROM reach JOIN ends ON x = reach.doc_id),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS g FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hits AS (SELECT r, i, i > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) + 400 AS fresh FROM win JOIN twice USING (g)),
runs AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM hits) GROUP BY r, k),
ends AS (SELECT r, s, e FROM runs UNION ALL SELECT r, n, n FROM d),
parts AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s, e) AS a, s AS b FROM ends),
kept AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM parts JOIN d USING (r) WHERE b > a GROUP BY r),
gone AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_quality": OP1,
    "op3_fair_queue_mix": OP3,
    "op4_seed_extend_dedup": OP4,
    "op5_decontamination": OP5,
    "op6_suffix_index_dedup": OP6,
    "op8_host_reputation": OP8,
    "op9_jaccard_prefix_join": OP9,
    "op10_warc_archive": OP10,
}
