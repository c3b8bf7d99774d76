"""Reference SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

import unicodedata

from gleaner.functions.text import TOKEN_PATTERN
from gleaner.plans.workload import (
    ARTICLES_RAW,
    ASKED_PAGES,
    FINE_PLANES,
    FINE_PROBES,
    KEYWORD,
    LSH_PLANES,
    LSH_PROBES,
    SCRIPTS,
    SEARCH_DIM,
    SEARCH_QUERIES,
    STATS_THRESHOLD,
    STRICT_THRESHOLD,
)
from gleaner.settings import SCORE_THRESHOLD

HASHED_NAME = "CAST(concat('0x', substr(sha256(name), 1, 15)) AS BIGINT)"
ASKED = SEARCH_QUERIES.replace("{key}", HASHED_NAME)

PAGED = ASKED_PAGES.replace("{key}", HASHED_NAME).replace("explode(sequence(0, 15))", "unnest(range(16))")

RAW = f"raw AS ({ARTICLES_RAW})"

BLANKS = "concat(' ', chr(9), chr(10), chr(13))"


def _id(url: str) -> str:
    return f"CAST(concat('0x', substr(sha256(trim({url}, {BLANKS})), 1, 15)) AS BIGINT)"


ART = f"""{RAW},
art AS (
  SELECT {_id('link')} AS id, seq, nguon, tieu_de, ngay_dang, tac_gia, summary,
    CAST(round_even(TRY_CAST(so_binh_luan AS DOUBLE), 0) AS BIGINT) AS so_binh_luan,
    link, noi_dung,
    lower(strip_accents(concat(coalesce(tieu_de, ''), ' ', coalesce(summary, ''))))
      AS search_blob
  FROM (SELECT *, row_number() OVER (
          PARTITION BY trim(link, {BLANKS}) ORDER BY seq) AS nth
        FROM raw WHERE trim(link, {BLANKS}) <> '')
  WHERE nth = 1)"""

ITEM = """id, tieu_de AS title, ngay_dang AS publish_date, tac_gia AS author,
  nguon AS source, link AS url, so_binh_luan AS comments, summary,
  CAST(NULL AS VARCHAR) AS image"""

LATEST = "ORDER BY ngay_dang DESC NULLS LAST, id"
FEATURED = "ORDER BY so_binh_luan DESC NULLS LAST, id"
PUBLIC = "id, title, publish_date, author, source, url, comments, summary, image"


def _page(order: str, start: int, limit: int, where: str = "true") -> str:
    return f"""WITH {ART}
SELECT {ITEM}, row_number() OVER ({order}) - 1 - {start} AS position
FROM art WHERE {where}
QUALIFY position BETWEEN 0 AND {limit - 1}"""


def _envelope(page: int, limit: int, where: str = "true", query: str | None = None) -> str:
    echo = f"'{query}' AS query, " if query is not None else ""
    return f"""WITH {ART}
SELECT {echo}count(*) AS total, CAST({page} AS INTEGER) AS page,
  CAST({limit} AS INTEGER) AS "limit",
  CAST(greatest(1, ceil(count(*) / {limit}::DOUBLE)) AS BIGINT) AS total_pages
FROM art WHERE {where}"""


def _holds(text: str) -> str:
    return f"contains(search_blob, lower(strip_accents('{text}')))"


TEXT = f"trim(concat(coalesce(tieu_de, ''), chr(10), coalesce(summary, '')), {BLANKS})"

BUCKETS = f"""
  SELECT id, CAST(concat('0x', substr(md5(word), 1, 8)) AS BIGINT) % {SEARCH_DIM} AS pos,
    count(*) AS x
  FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS word
        FROM {{src}})
  GROUP BY ALL"""

POINTS = f"""{ART},
points AS (SELECT id, tieu_de, summary, ngay_dang, {TEXT} AS text FROM art),
doc_words AS ({BUCKETS.format(src='points')})"""

EMB = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"""

KNN = f"""WITH {EMB},
scored AS (
  SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score
  FROM e q, e c),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM scored)
"""

VECTORS = f"""{ART},
vec AS (
  SELECT CASE WHEN trim(link, {BLANKS}) <> '' THEN {_id('link')} ELSE vec_id END AS id,
    embedding
  FROM embeddings JOIN raw ON vec_id = seq)"""

CANDIDATES = f"""{POINTS},
doc_norm AS (SELECT id, sum(x * x) AS n FROM doc_words GROUP BY id),
asked AS (SELECT query_id, query FROM ({ASKED}) WHERE trim(query, {BLANKS}) <> ''),
asked_text AS (SELECT query_id AS id, query AS text FROM asked),
query_words AS ({BUCKETS.format(src='asked_text')}),
query_norm AS (SELECT id, sum(x * x) AS n FROM query_words GROUP BY id),
dots AS (
  SELECT q.id AS query_id, d.id, sum(q.x * d.x) AS dot
  FROM query_words q JOIN doc_words d USING (pos) GROUP BY ALL),
ranked AS (
  SELECT query_id, d.id, round(CAST(dot AS DOUBLE) / sqrt(CAST(qn.n * dn.n AS DOUBLE)), 6)
      AS cosine,
    row_number() OVER (PARTITION BY query_id ORDER BY
      round(CAST(dot AS DOUBLE) / sqrt(CAST(qn.n * dn.n AS DOUBLE)), 6) DESC, d.id) AS first_rank
  FROM dots d JOIN query_norm qn ON qn.id = query_id JOIN doc_norm dn ON dn.id = d.id),
candidates AS (
  SELECT query_id, query, id, cosine, first_rank, tieu_de, summary, link, ngay_dang, nguon,
    noi_dung, coalesce(nullif(summary, ''), tieu_de, '') AS passage
  FROM ranked JOIN art USING (id) JOIN asked USING (query_id)
  WHERE first_rank <= 30)"""

WANTED = f"list_distinct(regexp_extract_all(lower(query), '{TOKEN_PATTERN}'))"
FOUND = f"list_distinct(regexp_extract_all(lower(passage), '{TOKEN_PATTERN}'))"
LEXICAL = f"""lexical AS (
  SELECT *, round(1 / (1 + exp(-(CASE WHEN len({WANTED}) = 0 THEN 0.0
      ELSE len(list_intersect({WANTED}, {FOUND}))::DOUBLE / len({WANTED}) END))), 6) AS score
  FROM candidates{{where}}),
final AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, first_rank) AS INTEGER) AS rank
  FROM lexical)"""
CUT = LEXICAL.format(where=f" WHERE cosine >= {SCORE_THRESHOLD}")

RESULT = """query_id, rank, id, tieu_de AS title, summary, noi_dung AS content, link AS url,
  CAST(NULL AS VARCHAR) AS image, ngay_dang AS date, nguon AS source, score"""

ENTRIES = """entries AS (
  SELECT p.id, CAST(pos AS INTEGER) AS pos, x, nullif(tieu_de, '') AS title,
    nullif(ngay_dang, '') AS publish_date
  FROM points p JOIN doc_words USING (id))"""

PLANES = "[" + ", ".join(str(plane.tolist()) for plane in LSH_PLANES) + "]"
LSH = f"""WITH {EMB},
planes AS (SELECT unnest({PLANES}) AS p, unnest(range({len(LSH_PLANES)})) AS b),
projected AS (SELECT id, b, list_inner_product(v, p) AS x FROM e, planes),
placed AS (
  SELECT id, sum(CASE WHEN x > 0 THEN 1 << b ELSE 0 END) AS cell FROM projected GROUP BY id),
costs AS (
  SELECT id AS query_id, cell,
    sum(CASE WHEN (x > 0) <> ((cell >> b) & 1 = 1) THEN x * x ELSE 0 END) AS cost
  FROM projected, (SELECT unnest(range({2 ** len(LSH_PLANES)})) AS cell) GROUP BY ALL),
probed AS (
  SELECT query_id, cell FROM costs
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cost, cell) <= {LSH_PROBES}),
scored AS (
  SELECT query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score
  FROM probed JOIN placed USING (cell) JOIN e c ON c.id = placed.id JOIN e q ON q.id = query_id),
near AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 30)"""

# The same without a table of all cells: sets of up to three crossed planes, which hold the
# eight cheapest (a fourth plane costs more than its three subsets of two and itself).
FINE = f"""WITH {EMB},
planes AS (SELECT unnest({[plane.tolist() for plane in FINE_PLANES]}) AS p,
  CAST(unnest(range({len(FINE_PLANES)})) AS BIGINT) AS b),
projected AS (SELECT id, b, list_inner_product(v, p) AS x FROM e, planes),
placed AS (
  SELECT id, CAST(sum(CASE WHEN x > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS cell
  FROM projected GROUP BY id),
near_planes AS (
  SELECT id, 1 << b AS flip, x * x AS cost FROM projected
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(x)) <= {FINE_PROBES}),
sets AS (
  SELECT id, 0 AS flip, 0.0 AS cost FROM placed
  UNION ALL SELECT id, flip, cost FROM near_planes
  UNION ALL SELECT a.id, a.flip | b.flip, a.cost + b.cost
  FROM near_planes a JOIN near_planes b ON a.id = b.id AND a.flip < b.flip
  UNION ALL SELECT a.id, a.flip | b.flip | c.flip, a.cost + b.cost + c.cost
  FROM near_planes a JOIN near_planes b ON a.id = b.id AND a.flip < b.flip
    JOIN near_planes c ON a.id = c.id AND b.flip < c.flip),
probed AS (
  SELECT sets.id AS query_id, xor(placed.cell, sets.flip) AS cell
  FROM sets JOIN placed USING (id)
  QUALIFY row_number() OVER (PARTITION BY sets.id ORDER BY cost) <= {FINE_PROBES}),
scored AS (
  SELECT query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score
  FROM probed JOIN placed USING (cell) JOIN e c ON c.id = placed.id JOIN e q ON q.id = query_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
FROM scored QUALIFY rank = 1"""

# Decomposed by tables written out: the letters of the keywords that the fold changes.
FOLDED_SCRIPTS = [
    "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    .lower().strip()
    for text in SCRIPTS
]


def _list(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{text}'" for text in texts) + "]"


SCRIPT_TOTALS = f"""WITH {RAW},
kept AS (
  SELECT seq, lower(strip_accents(concat(coalesce(tieu_de, ''), ' '))) AS head,
    {_list(FOLDED_SCRIPTS)}[seq % {len(SCRIPTS)} + 1] AS word,
    lower(strip_accents(coalesce(summary, ''))) AS tail
  FROM raw WHERE trim(link, {BLANKS}) <> ''
  QUALIFY row_number() OVER (PARTITION BY trim(link, {BLANKS}) ORDER BY seq) = 1),
asked AS (SELECT unnest({_list(FOLDED_SCRIPTS)}) AS q,
  CAST(unnest(range({len(SCRIPTS)})) AS INTEGER) AS nth)
SELECT nth, count(seq) AS total, min(seq) AS first_seq
FROM asked LEFT JOIN kept ON q <> '' AND contains(concat(head, word, ' ', tail), q)
GROUP BY nth"""

ORACLE: dict[str, str] = {
    "prepare_articles": f"WITH {ART} SELECT * FROM art",
    "csv_scan": f"""WITH {ART}
SELECT * REPLACE (nullif(tieu_de, '') AS tieu_de, nullif(summary, '') AS summary,
  nullif(noi_dung, '') AS noi_dung) FROM art""",
    "rdbms_metadata_scan": f"""WITH {ART}
SELECT id, seq, nguon, tieu_de, CASE WHEN ngay_dang <> 'abc' THEN ngay_dang END AS ngay_dang,
  tac_gia, summary, so_binh_luan, link FROM art""",
    "article_store_append": f"WITH {ART} SELECT id, seq, link, so_binh_luan, noi_dung FROM art",
    "reject_bad_urls": f"""WITH {RAW}
SELECT seq, link, tieu_de FROM raw WHERE coalesce(trim(link, {BLANKS}), '') = ''""",
    "dedupe_report": f"""WITH {RAW},
keyed AS (SELECT nullif(trim(link, {BLANKS}), '') AS k FROM raw)
SELECT count(*) AS total_rows, count(*) - count(k) AS rejected_rows,
  count(DISTINCT k) AS kept_rows, count(k) - count(DISTINCT k) AS dropped_rows
FROM keyed""",
    "page_json": f"""WITH {ART},
top AS (SELECT * FROM art {LATEST} LIMIT 10)
SELECT CAST(to_json(x) AS VARCHAR) AS json
FROM (SELECT struct_pack(id := CAST(id AS VARCHAR), title := tieu_de,
        publish_date := ngay_dang, author := tac_gia, source := nguon, url := link,
        comments := so_binh_luan, summary := summary, image := CAST(NULL AS VARCHAR)) AS x
      FROM top)""",
    "latest_page_1": _page(LATEST, 0, 10),
    "latest_page_3": _page(LATEST, 40, 20),
    "latest_past_end": _page(LATEST, 9_999_999_800, 100),
    "latest_page_deep": _page(LATEST, 105, 35),
    "latest_envelope": _envelope(3, 20),
    "featured_top5": _page(FEATURED, 0, 5),
    "featured_envelope": _envelope(1, 5),
    "categories": f"""WITH {ART}
SELECT coalesce(nguon, 'Khác') AS name, count(*) AS count FROM art GROUP BY 1""",
    "category_total": f"""WITH {ART}
SELECT count(DISTINCT coalesce(nguon, 'Khác')) AS total FROM art""",
    "keyword_hit": _page("ORDER BY seq", 50, 50, _holds("that the")),
    "keyword_accent": _page("ORDER BY seq", 0, 100, _holds(KEYWORD)),
    "keyword_scripts": SCRIPT_TOTALS,
    "latest_page_stored": _page(LATEST, 20, 20),
    "featured_stored": _page(FEATURED, 0, 5),
    "keyword_stored": _page("ORDER BY seq", 50, 50, _holds("that the")),
    "store_counts": f"""WITH {ART}
SELECT 'articles' AS store, count(*) AS n FROM art
UNION ALL SELECT 'vectors', count(DISTINCT id) FROM art""",
    "build_report": f"""WITH {ART},
half AS (SELECT count(*) AS n, count_if({TEXT} = '') AS blank FROM art
  WHERE ngay_dang < '2024-07-01'),
whole AS (SELECT count(*) AS n, count_if({TEXT} = '') AS blank FROM art)
SELECT CAST(0 AS INTEGER) AS build, n AS encoded, CAST(blank AS BIGINT) AS empty_texts,
  CAST(0 AS BIGINT) AS already_stored FROM half
UNION ALL SELECT 1, whole.n - half.n, CAST(whole.blank - half.blank AS BIGINT), half.n
FROM whole, half""",
    "keyword_page_envelope": _envelope(2, 100, _holds(KEYWORD), KEYWORD),
    "keyword_matches": f"WITH {ART} SELECT id, seq FROM art WHERE {_holds(KEYWORD)}",
    "keyword_passages": f"""WITH {ART},
asked AS (SELECT item_id AS query_id, trim(lower(strip_accents(text)), {BLANKS}) AS q
          FROM benchmark)
SELECT query_id, id, seq FROM art JOIN asked ON contains(search_blob, q)
WHERE q <> ''""",
    "keyword_words": f"""WITH {ART},
words AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
          FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
asked AS (SELECT {_id("concat(item_id, '/', pos)")} AS query_id,
            trim(lower(strip_accents(word)), {BLANKS}) AS q FROM words)
SELECT query_id, count(*) AS total, min(seq) AS first_seq
FROM art JOIN asked ON contains(search_blob, q) WHERE q <> '' GROUP BY query_id""",
    "keyword_batch_spread": f"""WITH {ART},
asked AS (SELECT query_id, trim(lower(strip_accents(query)), {BLANKS}) AS q FROM ({PAGED}))
SELECT query_id, id, seq FROM art JOIN asked ON contains(search_blob, q) WHERE q <> ''""",
    "keyword_batch_pages": f"""WITH {ART},
asked AS (SELECT query_id, query, trim(lower(strip_accents(query)), {BLANKS}) AS q FROM ({PAGED})),
found AS (
  SELECT query_id, art.*, row_number() OVER (PARTITION BY query_id ORDER BY seq) - 6 AS position
  FROM art JOIN asked ON contains(search_blob, q) WHERE q <> ''),
totals AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id),
page AS (SELECT query_id, {ITEM}, position FROM found WHERE position BETWEEN 0 AND 4)
SELECT asked.query_id, query, coalesce(n, 0) AS total, CAST(2 AS INTEGER) AS page,
  CAST(5 AS INTEGER) AS "limit",
  CAST(greatest(1, ceil(coalesce(n, 0) / 5::DOUBLE)) AS BIGINT) AS total_pages,
  position, page.* EXCLUDE (query_id, summary, position)
FROM asked LEFT JOIN totals USING (query_id) LEFT JOIN page ON page.query_id = asked.query_id""",
    "display_items": f"""WITH {ART}
SELECT * REPLACE (
  coalesce(strftime(TRY_CAST(publish_date AS DATE), '%d/%m/%Y'), publish_date, '')
    AS publish_date,
  coalesce(author, 'Ẩn danh') AS author, coalesce(title, 'Không có tiêu đề') AS title)
FROM (SELECT {ITEM} FROM art)""",
    "page_document": f"""WITH {ART}
SELECT (SELECT count(*) FROM art) AS total, CAST(2 AS INTEGER) AS page,
  CAST(10 AS INTEGER) AS "limit",
  CAST(greatest(1, ceil((SELECT count(*) FROM art) / 10.0)) AS BIGINT) AS total_pages,
  CAST(row_number() OVER ({LATEST}) - 11 AS INTEGER) AS position, id, tieu_de AS title
FROM art QUALIFY position BETWEEN 0 AND 9""",
    "category_document": f"""WITH {ART},
c AS (SELECT coalesce(nguon, 'Khác') AS name, count(*) AS count FROM art GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS total,
  CAST(row_number() OVER (ORDER BY count DESC, name) - 1 AS INTEGER) AS position, name, count
FROM c""",
    "embedding_text": f"WITH {POINTS} SELECT id, text FROM points",
    "payload": f"""WITH {ART}
SELECT id, nullif(tieu_de, '') AS title, nullif(summary, '') AS summary,
  nullif(ngay_dang, '') AS publish_date FROM art""",
    "mean_pool_vectors": f"""WITH {EMB},
x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e)
SELECT id, CAST(i % 16 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM x GROUP BY id, i % 16""",
    "l2_normalize_vectors": f"""WITH {EMB},
x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos,
        sqrt(list_inner_product(v, v)) AS n FROM e)
SELECT id, CAST(pos AS INTEGER) AS pos, round(x / n, 6) AS x FROM x""",
    "hashing_embedder": f"""WITH {POINTS}
SELECT id, CAST(pos AS INTEGER) AS pos, x FROM doc_words""",
    "distinct_queries": f"""WITH q AS ({ASKED}),
twice AS (SELECT query_id, query FROM q
  UNION ALL SELECT {_id("concat('again/', query_id)")}, concat(chr(10), ' ', query) FROM q)
SELECT trim(query, {BLANKS}) AS memo_key, min(query_id) AS rep_id,
  arg_min(query, query_id) AS query, count(*) AS n
FROM twice WHERE trim(query, {BLANKS}) <> '' GROUP BY 1""",
    "knn_exact": f"""WITH {EMB},
m AS (SELECT list(m ORDER BY pos) AS v FROM (
        SELECT pos, avg(x) AS m FROM (
          SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos))
SELECT id, round(list_cosine_similarity(e.v, m.v), 6) AS score FROM e, m
ORDER BY score DESC, id LIMIT 30""",
    "knn_blocked": KNN + "SELECT * FROM ranked WHERE rank <= 30",
    "knn_blocked_passes": KNN + "SELECT * FROM ranked WHERE rank <= 30",
    "knn_lsh_all_cells": KNN + "SELECT * FROM ranked WHERE rank <= 30",
    "knn_threshold": KNN
    + f"SELECT * FROM ranked WHERE rank <= 30 AND score >= {STATS_THRESHOLD}",
    "knn_score_stats": KNN
    + f"""SELECT query_id, count(*) AS n_hits, min(score) AS min_score, max(score) AS max_score
FROM ranked WHERE rank <= 30 AND score >= {STATS_THRESHOLD} GROUP BY query_id""",
    "knn_best_when_empty": f"""WITH {EMB},
q AS (SELECT a.id, list_transform(generate_series(1, len(a.v)),
        lambda i: CAST(CAST(a.v[i] AS FLOAT) - CAST(b.v[i] AS FLOAT) AS DOUBLE)) AS v
      FROM e a JOIN e b ON b.id = a.id + 1)
SELECT q.id AS query_id, max(round(list_cosine_similarity(q.v, e.v), 6)) AS best_score
FROM q, e GROUP BY q.id HAVING best_score < 0.7""",
    "upsert_latest_wins": """
SELECT id, CAST(pos AS INTEGER) AS pos, round(sign * CAST(x AS DOUBLE), 6) AS x FROM (
  SELECT vec_id AS id, CASE WHEN label < 5 THEN -1 ELSE 1 END AS sign,
    unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "upsert_order": """
SELECT id, CAST(pos AS INTEGER) AS pos, round(CAST(x AS DOUBLE) * 4, 6) AS x FROM (
  SELECT vec_id AS id, unnest(embedding) AS x,
    generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "pending_ids": f"WITH {VECTORS} SELECT id FROM art WHERE id NOT IN (SELECT id FROM vec)",
    "pending_articles": f"""WITH {VECTORS}
SELECT id, seq, tieu_de FROM art WHERE id NOT IN (SELECT id FROM vec)""",
    "orphan_ids": f"WITH {VECTORS} SELECT id FROM vec WHERE id NOT IN (SELECT id FROM art)",
    "index_audit": f"""WITH {VECTORS}
SELECT 'articles' AS metric, count(*) AS value FROM art
UNION ALL SELECT 'vectors', count(*) FROM vec
UNION ALL SELECT 'covered', count(DISTINCT id) FROM vec WHERE id IN (SELECT id FROM art)
UNION ALL SELECT 'pending', count(DISTINCT id) FROM art WHERE id NOT IN (SELECT id FROM vec)
UNION ALL SELECT 'orphans', count(DISTINCT id) FROM vec WHERE id NOT IN (SELECT id FROM art)
UNION ALL SELECT 'repeated_article_ids', count(*) - count(DISTINCT id) FROM art
UNION ALL SELECT 'repeated_vector_ids', count(*) - count(DISTINCT id) FROM vec
UNION ALL SELECT 'empty_texts', count(*) FROM art WHERE {TEXT} = ''
UNION ALL SELECT 'wrong_dimension', count(*) FROM vec WHERE len(embedding) <> 64""",
    "full_build": f"WITH {POINTS}, {ENTRIES} SELECT * FROM entries",
    "incremental_build": f"WITH {POINTS}, {ENTRIES} SELECT * FROM entries",
    "stream_ingest": f"""WITH {POINTS}, {ENTRIES}
SELECT * FROM (SELECT id, seq, link FROM art) LEFT JOIN entries USING (id)""",
    "knn_lsh_fine": FINE,
    "knn_lsh": LSH + " SELECT * FROM near",
    "knn_lsh_recall": LSH
    + """,
every AS (
  SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score
  FROM e q, e c),
best AS (SELECT query_id, id FROM every
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30)
SELECT count(*) AS neighbours, count(near.id) AS found
FROM best LEFT JOIN near ON near.query_id = best.query_id AND near.id = best.id""",
    "search_diagnostics": KNN
    + f"""SELECT query_id, count(*) FILTER (score >= {STRICT_THRESHOLD}) AS n_hits,
  min(score) FILTER (score >= {STRICT_THRESHOLD}) AS min_score,
  max(score) FILTER (score >= {STRICT_THRESHOLD}) AS max_score, max(score) AS best_score
FROM ranked WHERE rank <= 30 AND id <> query_id GROUP BY query_id""",
    "semantic_search_lexical": f"WITH {CANDIDATES}, {CUT} SELECT {RESULT} FROM final WHERE rank <= 10",
    "semantic_search_passthrough": f"""WITH {CANDIDATES},
final AS (SELECT *, CAST(first_rank AS INTEGER) AS rank, cosine AS score FROM candidates
          WHERE cosine >= {SCORE_THRESHOLD})
SELECT {RESULT} FROM final WHERE rank <= 10""",
    "search_as_list": f"""WITH {CANDIDATES}, {CUT}
SELECT query_id, rank, id, tieu_de AS title, ngay_dang AS publish_date,
  CAST(NULL AS VARCHAR) AS author, nguon AS source, link AS url,
  CAST(NULL AS BIGINT) AS comments, summary, CAST(NULL AS VARCHAR) AS image
FROM final WHERE rank <= 10""",
    "search_list_envelopes": f"""WITH {CANDIDATES}, {CUT},
totals AS (SELECT query_id, count(*) AS n FROM final WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, query, coalesce(n, 0) AS total, CAST(1 AS INTEGER) AS page,
  coalesce(n, 10) AS "limit", CAST(1 AS INTEGER) AS total_pages
FROM ({ASKED}) LEFT JOIN totals USING (query_id)""",
    "rerank_lexical": f"""WITH {CANDIDATES}, {LEXICAL.format(where='')}
SELECT query_id, id, score, rank FROM final""",
    "rerank_fallback": f"""WITH {CANDIDATES},
scored AS (SELECT query_id, id, first_rank,
  CASE WHEN contains(query, ',') THEN cosine ELSE length(passage)::DOUBLE END AS score
  FROM candidates)
SELECT query_id, id, score, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, first_rank) AS INTEGER) AS rank FROM scored""",
    "rerank_listwise": f"""WITH {CANDIDATES},
scored AS (SELECT query_id, id, first_rank, CAST(count(*) OVER (PARTITION BY query_id) * 100
  + row_number() OVER (PARTITION BY query_id ORDER BY first_rank) - 1 AS DOUBLE) AS score
  FROM candidates)
SELECT query_id, id, score, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC) AS INTEGER) AS rank FROM scored""",
    "rerank_score_shapes": f"""WITH {CANDIDATES},
scored AS (SELECT query_id, id, first_rank,
  CASE WHEN length(query) % 3 <> 0 THEN cosine ELSE length(passage)::DOUBLE END AS score
  FROM candidates)
SELECT query_id, id, score, CAST(row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, first_rank) AS INTEGER) AS rank FROM scored""",
    "content_lookup": f"""WITH {ART}
SELECT id, noi_dung AS content FROM art {FEATURED} LIMIT 100""",
}
