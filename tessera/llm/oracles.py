"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS place FROM d),
w AS (SELECT doc_id, place, line AS l0, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(place, 2) OVER o AS ends
      FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, place) AS nth FROM w
      WHERE ends IS NOT NULL AND regexp_matches(l0 || chr(10) || l1 || chr(10) || l2, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, place + k AS place FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1),
m AS (SELECT l.doc_id, l.place, l.line, c.place IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.place = c.place),
g AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM m WHERE gone),
s AS (SELECT doc_id, string_agg(span, ',' ORDER BY first) AS removed
      FROM (SELECT doc_id, min(place) AS first, min(place) || '-' || max(place) AS span FROM g GROUP BY doc_id, run) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
      coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       coalesce(s.removed, '') AS removed, t.text AS text
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

OP6 = r"""
WITH z AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s0),
s2 AS (SELECT *, 3 * source_size / weight AS full_at, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS nth FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s1) - coalesce(sum(3 * source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
lv AS (SELECT level FROM s3 WHERE level <= full_at ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, least(lv.level * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM s3, lv),
r AS (SELECT z.doc_id, z.size, t.source_size, t.target,
        row_number() OVER (PARTITION BY z.source ORDER BY z.size DESC, z.doc_id NULLS LAST) AS nth,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('mix:' || coalesce(z.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296.0 AS DOUBLE) AS u
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  least(CAST(floor(nth * rate + u) - floor((nth - 1) * rate + u) AS BIGINT), 3) * size AS taken,
  least(CAST(floor(nth * rate + u) - floor((nth - 1) * rate + u) AS BIGINT), 3) AS copies
FROM r
"""

OP3 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
l AS (SELECT d.doc_id, CAST(coalesce(sum(p.tf), 0) AS DOUBLE) AS len FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len) / count(*) AS mean FROM l),
f AS (SELECT term, ln(CAST(1 AS DOUBLE) + (a.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, a GROUP BY term, a.n),
v AS (SELECT p.doc_id, p.term, p.tf * CAST(2.2 AS DOUBLE) / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.len / a.mean)) AS value FROM p JOIN l USING (doc_id), a),
s AS (SELECT q.doc_id AS query_id, v.doc_id, sum(round(q.tf * f.idf * v.value * 1000000)) AS score
      FROM p q JOIN f USING (term) JOIN v USING (term) WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, v.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score / 1000000 AS score FROM r WHERE rank <= 10
"""

ORACLES = {"op3_search": OP3, "op2_line_dedup": OP2, "op6_mixing": OP6}
