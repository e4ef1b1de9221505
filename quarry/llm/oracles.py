"""DuckDB twins of the text queries that SQL can express."""

PHRASES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT rid, lang, unnest(range(len(a))) AS i, unnest(a) AS piece
  FROM (SELECT rid, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS a FROM d)),
w AS (
  SELECT rid, lang, i, unnest(range(len(ws))) AS j, unnest(ws) AS w1
  FROM (SELECT rid, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY rid, i ORDER BY j)),
one AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
inside AS (
  SELECT lang, v1, v2, max(f) AS f
  FROM (SELECT lang, w1 AS v1, w2 AS v2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r
  FROM two JOIN one x ON x.lang = two.lang AND x.w1 = two.w1 JOIN one y ON y.lang = two.lang AND y.w1 = two.w2
  LEFT JOIN inside z ON z.lang = two.lang AND z.v1 = two.w1 AND z.v2 = two.w2
  WHERE z.f IS NULL OR 100 * z.f < 50 * two.f
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best JOIN total ON total.lang = best.lang
QUALIFY rank <= 2000
"""

SUFFIXES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
w AS (
  SELECT rid, id, p, substr(hx, 2 * p + 1, 100) AS s
  FROM (SELECT rid, id, hx, unnest(range(0, length(hx) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(id) AS least FROM w GROUP BY s),
hit AS (SELECT rid, p FROM w JOIN m ON w.s = m.s WHERE least < id),
steps AS (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM hit),
runs AS (
  SELECT rid, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS g FROM steps),
spans AS (SELECT rid, g, min(p) AS a, max(p) + 50 AS z FROM runs GROUP BY rid, g),
gaps AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM spans),
kept AS (
  SELECT gaps.rid, string_agg(substr(hx, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(z) AS last,
         sum(z - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d ON d.rid = gaps.rid GROUP BY gaps.rid)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN hx ELSE head || substr(hx, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid
"""
