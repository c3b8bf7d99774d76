"""SQL of the operators that it can express, for comparison on the same tables."""

from __future__ import annotations

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
    min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM d),
told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
      THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN told USING (doc_id)),
m AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM c GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit,
    coalesce(list_sum(bits[1:step - 1]), 0) AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, (SELECT filter_order, step, bit, CAST(earlier AS INTEGER) AS earlier FROM s)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM t
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]+')) AS piece
  FROM documents),
w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS ws
  FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM w),
g AS (
  SELECT lang, k, len(ws) AS size, ws[k] AS w1, ws[k + 1] AS w2, ws[k + 2] AS w3 FROM i),
f AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL
  SELECT lang, 2, concat(w1, ' ', w2), count(*) FROM g WHERE k < size GROUP BY ALL
  UNION ALL
  SELECT lang, 3, concat(w1, ' ', w2, ' ', w3), count(*) FROM g WHERE k < size - 1 GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f
  WHERE words > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x,
    array_to_string(ws[k + 1:], ' ') AS y
  FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < words),
scored AS (
  SELECT cuts.*, lf.f AS l, rf.f AS r,
    CAST((1000000::HUGEINT * a * a) // (lf.f::HUGEINT * rf.f) AS BIGINT) AS score
  FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = x AND lf.words = k
    JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = y),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM cand WHERE words = 3
  UNION ALL
  SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE words = 3),
longest AS (SELECT lang, phrase, max(a) AS longer FROM around GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longest USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang
    ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""

ORACLE = {"op11_filter_audit": FILTER_AUDIT, "op12_collocations": COLLOCATIONS}
