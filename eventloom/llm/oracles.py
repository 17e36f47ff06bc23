"""DuckDB SQL with the results of the queries that SQL can express."""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(nullif(regexp_extract(lower(source), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(?:www\.)?([^/:?#]+)', 1), ''), source) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS at FROM k, (VALUES (0), (1), (2)) v(j) WHERE c > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        100 * n_symbols > 5 * n_words OR 100 * n_dup_lines > 10 * n_words AS soft_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS n, sum((base_failed OR soft_failed)::INT)::DOUBLE AS bad FROM f GROUP BY host),
s AS (SELECT sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS sq, count(*) / sum(n) AS q FROM h),
b AS (SELECT mean, sq - mean * mean - q * mean * (1 - mean) AS var FROM s),
a AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1, least(1000, mean * (1 - mean) / var - 1)) ELSE 1000 END AS strength FROM b),
g AS (SELECT host, mean, n + strength AS size, (bad + mean * strength) / (n + strength) AS rate FROM h, a),
i AS (SELECT host, mean, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) AS low, rate + 1.645 * sqrt(rate * (1 - rate) / (size + 1)) AS high FROM g),
v AS (SELECT host, CASE WHEN high <= mean / 1.5 THEN 4 WHEN low >= mean * 1.5 THEN 1 ELSE 2 END AS halves,
        high > mean / 1.5 AND low >= mean * 1.5 AND low >= 0.5 AS condemned FROM i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR condemned OR 200 * n_symbols > halves * 5 * n_words OR 200 * n_dup_lines > halves * 10 * n_words) AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
live AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, live.key IS NOT NULL AND k.doc_id IS NOT NULL AND k.doc_id <> live.last AS gone FROM k LEFT JOIN live ON k.key = live.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN low USING (r) LEFT JOIN n USING (r)
"""

SQL: dict[str, str] = {"op4_ngram_join": JOIN, "op5_line_dedup": LINES, "op6_quality_rules": QUALITY}
