"""The registered queries: every operator over the given tables.

Articles come from ``documents``: the first line of a text is the title, the rest the
summary, all of it the content. The link is made from language and text, so exact
copies of a document are repeats of an article; some links carry outer blanks, some
are missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import stable_id
from gleaner.functions.vectors import l2_normalize, mean_pool
from gleaner.operators import audit, embed, hydrate, keyword_batch, knn, listing, prepare
from gleaner.operators import rerank as reranking
from gleaner.operators.paging import Page, slice_page
from gleaner.plans.build_vectors import FORCE, RECREATE, build_vectors
from gleaner.plans.semantic_search import as_list_items, list_envelopes, semantic_search
from gleaner.schemas import CONTENT_COLUMN
from gleaner.session import checkpoint_dir, scratch_path
from gleaner.sources.article_store import ArticleStore
from gleaner.sources.csv import CSV_SCHEMA, read_articles_csv, write_articles_csv
from gleaner.sources.jdbc import articles_from_news
from gleaner.sources.json_rows import to_json_rows
from gleaner.sources.vector_store import VectorStore
from gleaner.streaming.ingest import read_drops, start_ingest

# The same text runs on Spark and on the oracle.
ARTICLES_RAW = """
SELECT doc_id AS seq,
  CASE WHEN n_chars % 97 = 0 THEN NULL
       WHEN n_chars % 89 = 0 THEN '   '
       WHEN doc_id % 7 = 3
         THEN concat('  https://news.example/', lang, '/', md5(text), chr(10))
       ELSE concat('https://news.example/', lang, '/', md5(text)) END AS link,
  CASE WHEN doc_id % 40 = 7 THEN NULL ELSE split_part(text, chr(10), 1) END AS tieu_de,
  CASE WHEN doc_id % 15 = 4 THEN NULL
       ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS summary,
  text AS noi_dung,
  CASE WHEN doc_id % 25 = 3 THEN NULL ELSE source END AS nguon,
  CASE WHEN doc_id % 4 = 1 THEN NULL
       ELSE concat('author', CAST(doc_id % 50 AS STRING)) END AS tac_gia,
  CASE WHEN doc_id % 30 = 5 THEN NULL WHEN doc_id % 30 = 6 THEN 'abc'
       ELSE CAST(DATE '2024-01-01' + CAST((doc_id * 37) % 366 AS INT) AS STRING)
       END AS ngay_dang,
  CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'n/a'
       ELSE concat(CAST((doc_id * 7919) % 300 AS STRING),
                   CASE WHEN doc_id % 2 = 0 THEN '.5' ELSE '' END) END AS so_binh_luan
FROM documents
"""

# One query per conversation turn, and a blank one for each system turn. An id is a hash
# of what names the query; only the hash is written differently on the oracle.
SEARCH_QUERIES = """
SELECT {key} AS query_id, query FROM (
  SELECT concat(CAST(conv_id AS STRING), '/', CAST(turn AS STRING)) AS name,
    CASE WHEN role = 'assistant' THEN concat(' ', text, chr(10)) ELSE text END AS query
  FROM conversations
  UNION ALL
  SELECT concat('blank/', CAST(conv_id AS STRING), '/', CAST(turn AS STRING)), '  '
  FROM conversations WHERE role = 'system')
"""
# Queries of one, two and many words; every passage stands for itself and for a blank.
ASKED_PAGES = """
SELECT {key} AS query_id, query FROM (
  SELECT concat(CAST(item_id AS STRING), '/', CAST(k AS STRING)) AS name,
    CASE WHEN k = 0 THEN text WHEN k = 1 THEN '  ' WHEN k < 12 THEN split_part(text, ' ', k)
      ELSE concat(' ', split_part(text, ' ', k - 9), ' ', split_part(text, ' ', k - 8)) END
      AS query
  FROM benchmark, (SELECT explode(sequence(0, 15)) AS k))
"""
HASHED_NAME = "CAST(conv(substring(sha2(name, 256), 1, 15), 16, 10) AS BIGINT)"

# Keywords in several scripts, some blank. Documents get the first ones by turns.
SCRIPTS = [
    "한국", "하", "ভালো", "தமிழ்", "đồng", "مرحبا", "λόγος", "שלום",
    "the", "  ", " ́ ", "동",
]

KEYWORD = "thé"
LSH_BITS = 6
BUCKETS = 8
DROP_ROWS = 20_000  # of a file of a drop
SEARCH_DIM = 256
STATS_THRESHOLD = 0.25
STRICT_THRESHOLD = 0.45
LSH_PLANES = knn.random_planes(LSH_BITS, 64)
LSH_PROBES = 2 ** (LSH_BITS - 1)
FINE_PLANES, FINE_PROBES = knn.random_planes(24, 64), 8

embedder = partial(embed.HashingEmbedder, SEARCH_DIM)


class Tables:
    """The tables of one scale folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, name: str) -> DataFrame:
        return self.spark.sql(text.replace(name, "{src}"), src=self.table(name))

    def raw(self) -> DataFrame:
        return self._sql(ARTICLES_RAW, "documents")

    def articles(self, with_content: bool = False) -> DataFrame:
        return prepare.prepare_articles(self.raw(), with_content)

    def queries(self) -> DataFrame:
        return self._sql(SEARCH_QUERIES.replace("{key}", HASHED_NAME), "conversations")

    def embeddings(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))

    def embedding_queries(self) -> DataFrame:
        return self.embeddings().withColumnRenamed("id", "query_id")

    def article_vectors(self) -> DataFrame:
        """Given vectors under article ids; documents without a link keep their number."""
        links = self.raw().select(F.col("seq").alias("vec_id"), "link")
        url_id = F.when(~prepare.is_blank("link"), stable_id("link"))
        return (
            self.table("embeddings")
            .join(links, "vec_id")
            .select(
                F.coalesce(url_id, F.col("vec_id")).alias("id"),
                F.col("embedding").alias("vector"),
                "vec_id",
            )
        )

    def hashed_vectors(self) -> DataFrame:
        points = embed.points_to_embed(self.articles())
        return embed.embed_column(points, "text", embedder, SEARCH_DIM).select("id", "vector")

    def stored_articles(self) -> DataFrame:
        store = ArticleStore(self.spark, scratch_path(self.spark, "articles"), BUCKETS)
        store.append(self.articles(with_content=True))
        return store.read()

    def built_vectors(self, articles: DataFrame) -> DataFrame:
        """Built into a store, so that several search passes only scan."""
        store = VectorStore(self.spark, scratch_path(self.spark, "vectors"))
        build_vectors(articles, store, embedder, dim=SEARCH_DIM)
        return store.read()


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]):
    REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


# --- preparation and sources ---


@query
def prepare_articles(t: Tables) -> DataFrame:
    return t.articles(with_content=True)


@query
def reject_bad_urls(t: Tables) -> DataFrame:
    return prepare.rejected_urls(t.raw()).select("seq", "link", "tieu_de")


@query
def dedupe_report(t: Tables) -> DataFrame:
    return prepare.dedupe_report(t.raw())


@query
def csv_scan(t: Tables) -> DataFrame:
    """Written as CSV and read back, then prepared."""
    path = scratch_path(t.spark, "csv")
    names = [*CSV_SCHEMA.names, "seq"]
    write_articles_csv(t.raw().select(*names), path)
    schema = ", ".join(f"{n} string" for n in CSV_SCHEMA.names) + ", seq bigint"
    from pyspark.sql.types import StructType

    return prepare.prepare_articles(read_articles_csv(t.spark, path, StructType.fromDDL(schema)))


@query
def rdbms_metadata_scan(t: Tables) -> DataFrame:
    """The mapping of the relational table, on rows of its shape."""
    news = t.raw().select(
        F.col("seq").alias("id"),
        F.col("nguon").alias("source"),
        F.col("tieu_de").alias("title"),
        F.try_to_date("ngay_dang").alias("publish_date"),
        F.col("tac_gia").alias("author"),
        "summary",
        F.col("so_binh_luan").try_cast("double").alias("comments"),
        F.col("link").alias("url"),
        F.col(CONTENT_COLUMN).alias("content"),
    )
    return prepare.prepare_articles(articles_from_news(news)).drop("search_blob")


@query
def article_store_append(t: Tables) -> DataFrame:
    """Stored, offered again (nothing new), read back."""
    store = ArticleStore(t.spark, scratch_path(t.spark, "articles"), BUCKETS)
    rows = t.articles(with_content=True).persist()
    for _ in range(2):
        store.append(store.only_new(rows, rows.count()))
    rows.unpersist()
    return store.read().select("id", "seq", "link", "so_binh_luan", CONTENT_COLUMN)


@query
def page_json(t: Tables) -> DataFrame:
    """First page as JSON rows with ids as text."""
    return to_json_rows(
        listing.latest_news(t.articles()).drop("position"), id_as_string=True
    )


# --- listing ---


@query
def latest_page_1(t: Tables) -> DataFrame:
    return listing.latest_news(t.articles())


@query
def latest_page_3(t: Tables) -> DataFrame:
    return listing.latest_news(t.articles(), page=3, limit=20)


@query
def latest_past_end(t: Tables) -> DataFrame:
    return listing.latest_news(t.articles(), page=99_999_999, limit=100)


@query
def latest_page_deep(t: Tables) -> DataFrame:
    """A page taken by range instead of top-k."""
    order = [F.desc_nulls_last("publish_date"), F.asc("id")]
    items = listing.news_items(t.articles(), "seq")
    page = slice_page(items, "publish_date", order, Page.clamp(4, 35), top_k_rows=0)
    return page.select(*listing.ITEM_FIELDS, "position")


@query
def latest_envelope(t: Tables) -> DataFrame:
    return listing.latest_envelope(t.articles(), page=3, limit=20)


@query
def featured_top5(t: Tables) -> DataFrame:
    return listing.featured_news(t.articles())


@query
def featured_envelope(t: Tables) -> DataFrame:
    return listing.featured_envelope(t.articles())


@query
def categories(t: Tables) -> DataFrame:
    return listing.categories(t.articles())


@query
def category_total(t: Tables) -> DataFrame:
    return listing.category_total(t.articles())


@query
def keyword_hit(t: Tables) -> DataFrame:
    return listing.keyword_search(t.articles(), "THAT the", page=2, limit=50)


@query
def keyword_accent(t: Tables) -> DataFrame:
    return listing.keyword_search(t.articles(), f"  {KEYWORD.upper()} ", limit=100)


@query
def keyword_scripts(t: Tables) -> DataFrame:
    """Matches per keyword over all articles, each title with a word of some script added."""
    word = F.get(F.array(*map(F.lit, SCRIPTS)), F.pmod("seq", F.lit(len(SCRIPTS))).cast("int"))
    title = F.concat(F.coalesce("tieu_de", F.lit("")), F.lit(" "), word)
    path = scratch_path(t.spark, "articles")
    # Prepared once; every keyword then scans what it is looked up in.
    prepared = prepare.prepare_articles(t.raw().withColumn("tieu_de", title))
    prepared.select("seq", "search_blob").write.parquet(path)
    articles = t.spark.read.parquet(path)
    totals = [
        listing.keyword_matches(articles, query)
        .agg(F.count("*").alias("total"), F.min("seq").alias("first_seq"))
        .select(F.lit(nth).alias("nth"), "total", "first_seq")
        for nth, query in enumerate(SCRIPTS)
    ]
    return reduce(DataFrame.unionAll, totals)


@query
def latest_page_stored(t: Tables) -> DataFrame:
    """A page over the article store, which reads the buckets of the page's rows only."""
    return listing.latest_news(t.stored_articles(), page=2, limit=20)


@query
def featured_stored(t: Tables) -> DataFrame:
    return listing.featured_news(t.stored_articles())


@query
def keyword_stored(t: Tables) -> DataFrame:
    return listing.keyword_search(t.stored_articles(), "THAT the", page=2, limit=50)


@query
def store_counts(t: Tables) -> DataFrame:
    """Rows of an article store and of the vector store built from it, as the stores count."""
    articles = ArticleStore(t.spark, scratch_path(t.spark, "articles"), BUCKETS)
    articles.append(t.articles(with_content=True))
    vectors = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    build_vectors(articles.read(), vectors, embedder, dim=SEARCH_DIM)
    counts = [("articles", articles.count()), ("vectors", vectors.count())]
    return t.spark.createDataFrame(counts, "store string, n bigint")


@query
def build_report(t: Tables) -> DataFrame:
    """What two builds report: half of the articles, then all of them."""
    store = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    articles = t.stored_articles()
    half = articles.where("ngay_dang < '2024-07-01'")
    told = [build_vectors(part, store, embedder, dim=SEARCH_DIM) for part in (half, articles)]
    return t.spark.createDataFrame(
        [(n, r.encoded, r.empty_texts, r.already_stored) for n, r in enumerate(told)],
        "build int, encoded bigint, empty_texts bigint, already_stored bigint",
    )


@query
def keyword_page_envelope(t: Tables) -> DataFrame:
    return listing.keyword_envelope(t.articles(), KEYWORD, page=2, limit=500)


@query
def keyword_matches(t: Tables) -> DataFrame:
    """All matches, before paging."""
    return listing.keyword_matches(t.articles(), KEYWORD).select("id", "seq")


@query
def keyword_passages(t: Tables) -> DataFrame:
    """Every benchmark passage looked up in every article at once."""
    passages = t.table("benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return keyword_batch.keyword_batch(t.articles(), passages)


@query
def keyword_words(t: Tables) -> DataFrame:
    """Matches per word of the benchmark passages, repeated words asked repeatedly."""
    words = t.table("benchmark").select(
        "item_id", F.posexplode(F.split("text", " ")).alias("pos", "query")
    )
    name = F.concat(F.col("item_id").cast("string"), F.lit("/"), F.col("pos").cast("string"))
    asked = words.select(stable_id(name).alias("query_id"), "query")
    return keyword_batch.keyword_totals(t.articles(), asked)


def _asked_pages(t: Tables) -> DataFrame:
    """Words of the benchmark passages, neighbouring words, whole passages, blanks."""
    return t._sql(ASKED_PAGES.replace("{key}", HASHED_NAME), "benchmark")


@query
def keyword_batch_pages(t: Tables) -> DataFrame:
    """The second page of every query with its envelope."""
    pages = keyword_batch.keyword_pages(t.articles(), _asked_pages(t), page=2, limit=5)
    return pages.drop("summary")


@query
def keyword_batch_spread(t: Tables) -> DataFrame:
    """The same matches, all of them, with words and queries shuffled instead of broadcast."""
    return keyword_batch.keyword_batch(t.articles(), _asked_pages(t), broadcast_bytes=0)


@query
def display_items(t: Tables) -> DataFrame:
    return listing.display_items(listing.news_items(t.articles()))


@query
def page_document(t: Tables) -> DataFrame:
    """Envelope with nested items, flattened again."""
    articles = t.articles()
    doc = listing.page_document(
        listing.latest_news(articles, page=2), listing.latest_envelope(articles, page=2)
    )
    return doc.select(
        "total", "page", "limit", "total_pages", F.posexplode("items").alias("position", "item")
    ).select("total", "page", "limit", "total_pages", "position", "item.id", "item.title")


@query
def category_document(t: Tables) -> DataFrame:
    doc = listing.category_document(t.articles())
    return doc.select("total", F.posexplode("items").alias("position", "item")).select(
        "total", "position", "item.name", "item.count"
    )


# --- embedding texts, vectors ---


@query
def embedding_text(t: Tables) -> DataFrame:
    return embed.points_to_embed(t.articles()).select("id", "text")


@query
def payload(t: Tables) -> DataFrame:
    return embed.points_to_embed(t.articles()).select(
        F.col("payload.id").alias("id"), "payload.title", "payload.summary", "payload.publish_date"
    )


@query
def mean_pool_vectors(t: Tables) -> DataFrame:
    """Each vector cut into token vectors of 16, pooled; a rest of fewer is left out."""
    pieces = F.floor(F.size("vector") / 16).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), pieces - 1), lambda i: F.slice(F.col("vector"), i * 16 + 1, 16)
    )
    pooled = t.embeddings().select("id", F.posexplode(mean_pool(cut)).alias("pos", "x"))
    return pooled.select("id", "pos", F.round("x", 6).alias("x"))


@query
def l2_normalize_vectors(t: Tables) -> DataFrame:
    scaled = F.transform("vector", lambda x: x * (F.col("id") + 1))
    unit = t.embeddings().select("id", F.posexplode(l2_normalize(scaled)).alias("pos", "x"))
    return unit.select("id", "pos", F.round("x", 6).alias("x"))


@query
def hashing_embedder(t: Tables) -> DataFrame:
    """Non-zero coordinates of every article vector."""
    entries = t.hashed_vectors().select("id", F.posexplode("vector").alias("pos", "x"))
    return entries.where("x <> 0").select("id", "pos", F.col("x").cast("bigint").alias("x"))


@query
def distinct_queries(t: Tables) -> DataFrame:
    """Every query asked twice, once with outer blanks."""
    asked = t.queries()
    again = asked.select(
        stable_id(F.concat(F.lit("again/"), F.col("query_id").cast("string"))).alias("query_id"),
        F.concat(F.lit("\n "), "query").alias("query"),
    )
    return embed.distinct_queries(asked.unionAll(again))


# --- nearest neighbours ---


@query
def knn_exact(t: Tables) -> DataFrame:
    """The 30 nearest vectors to the mean of all vectors."""
    places = t.embeddings().select(F.posexplode("vector").alias("pos", "x"))
    means = places.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    center = means.agg(F.transform(ordered, lambda e: e["m"]).alias("v"))
    return knn.knn_one(t.embeddings(), center.scalar())


@query
def knn_blocked(t: Tables) -> DataFrame:
    return knn.knn_batch(t.embeddings(), t.embedding_queries())


@query
def knn_blocked_passes(t: Tables) -> DataFrame:
    """The same with more queries than one block and the corpus in many groups."""
    return knn.knn_grid(t.embeddings(), t.embedding_queries(), group_bytes=20_000)


@query
def knn_threshold(t: Tables) -> DataFrame:
    return knn.knn_batch(t.embeddings(), t.embedding_queries(), threshold=STATS_THRESHOLD)


@query
def knn_score_stats(t: Tables) -> DataFrame:
    return knn.score_stats(
        knn.knn_batch(t.embeddings(), t.embedding_queries(), threshold=STATS_THRESHOLD)
    )


@query
def search_diagnostics(t: Tables) -> DataFrame:
    """Counts and scores at a threshold few neighbours reach, from one pass."""
    hits = knn.knn_batch(t.embeddings(), t.embedding_queries())
    others = hits.where("id <> query_id")
    return knn.search_diagnostics(others, STRICT_THRESHOLD)


@query
def knn_best_when_empty(t: Tables) -> DataFrame:
    """Queries: vectors minus their neighbour in number, so that few reach the threshold."""
    e = t.embeddings()
    shifted = e.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    asked = e.join(shifted, "id").select(
        F.col("id").alias("query_id"),
        F.zip_with("vector", "next", lambda x, y: (x - y).cast("float")).alias("vector"),
    )
    best = knn.knn_batch(e, asked, k=1)
    return knn.best_when_empty(best, asked, 0.7)


def _cells(t: Tables, planes: np.ndarray) -> DataFrame:
    path = scratch_path(t.spark, "cells")
    if len(planes) > 12:  # too many folders; the cell is a column like any other
        knn.with_cell(t.embeddings(), planes).write.parquet(path)
    else:
        knn.write_cells(t.embeddings(), planes, path)
    return t.spark.read.parquet(path)


@query
def knn_lsh(t: Tables) -> DataFrame:
    """Approximate: half of the cells probed."""
    return knn.knn_lsh(
        _cells(t, LSH_PLANES), t.embedding_queries(), LSH_PLANES, probes=LSH_PROBES
    )


@query
def knn_lsh_recall(t: Tables) -> DataFrame:
    """How many of the true 30 neighbours the probed cells give, over all queries."""
    columns = ["query_id", "id"]
    true = knn.knn_batch(t.embeddings(), t.embedding_queries()).select(*columns)
    found = knn_lsh(t).select(*columns).withColumn("hit", F.lit(1))
    return true.join(found, columns, "left").agg(
        F.count("*").alias("neighbours"), F.count("hit").alias("found")
    )


@query
def knn_lsh_fine(t: Tables) -> DataFrame:
    """More planes than cells could be counted for; most rows have a cell of their own."""
    return knn.knn_lsh(
        _cells(t, FINE_PLANES), t.embedding_queries(), FINE_PLANES, probes=FINE_PROBES, k=1
    )


@query
def knn_lsh_all_cells(t: Tables) -> DataFrame:
    """Every cell probed, which is exact."""
    planes = knn.random_planes(LSH_BITS, 64)
    return knn.knn_lsh(_cells(t, planes), t.embedding_queries(), planes, probes=2**LSH_BITS)


# --- stores, builds, checks ---


def _point_payload():
    return F.struct(
        F.col("id"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("publish_date"),
    ).alias("payload")


@query
def upsert_latest_wins(t: Tables) -> DataFrame:
    """All vectors stored, those of some labels replaced by their negative, compacted."""
    store = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    store.ensure(64)
    e = t.table("embeddings").withColumn("id", F.col("vec_id"))
    points = e.select("id", F.col("embedding").alias("vector"), _point_payload())
    store.upsert(points, unique=True)
    negative = F.transform("embedding", lambda x: -x).alias("vector")
    store.upsert(e.where("label < 5").select("id", negative, _point_payload()))
    store.compact()
    whole = store.read().select("id", F.posexplode("vector").alias("pos", "x"))
    return whole.select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def upsert_order(t: Tables) -> DataFrame:
    """Each point given three times in one call; the one with the largest number stays."""
    store = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    store.ensure(64)
    e = t.table("embeddings").withColumn("id", F.col("vec_id"))
    times = e.withColumn("nth", F.explode(F.array(*map(F.lit, (2, 4, 1)))))
    scaled = F.transform("embedding", lambda x: (x * F.col("nth")).cast("float"))
    store.upsert(times.select("id", scaled.alias("vector"), _point_payload(), "nth"), order="nth")
    whole = store.read().select("id", F.posexplode("vector").alias("pos", "x"))
    return whole.select("id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def pending_ids(t: Tables) -> DataFrame:
    return audit.pending_ids(t.articles(), t.article_vectors())


@query
def pending_articles(t: Tables) -> DataFrame:
    rows = audit.pending_articles(t.articles(), t.article_vectors())
    return rows.select("id", "seq", "tieu_de")


@query
def orphan_ids(t: Tables) -> DataFrame:
    return audit.orphan_ids(t.article_vectors(), t.articles())


@query
def index_audit(t: Tables) -> DataFrame:
    return audit.index_audit(t.articles(), t.article_vectors(), 64)


def _stored_entries(store: VectorStore) -> DataFrame:
    """Non-zero coordinates of every stored vector, with the payload."""
    entries = store.read().select("id", "payload", F.posexplode("vector").alias("pos", "x"))
    return entries.where("x <> 0").select(
        "id", "pos", F.col("x").cast("bigint").alias("x"), "payload.title", "payload.publish_date"
    )


@query
def full_build(t: Tables) -> DataFrame:
    store = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    build_vectors(t.articles(), store, embedder, RECREATE, SEARCH_DIM)
    return _stored_entries(store)


@query
def incremental_build(t: Tables) -> DataFrame:
    """Half of the feed built, then the whole feed in slices, then a rerun and a forced one."""
    store = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    articles = t.stored_articles()
    dated = articles.where("ngay_dang < '2024-07-01'")
    build_vectors(dated, store, embedder, dim=SEARCH_DIM)
    build_vectors(articles, store, embedder, dim=SEARCH_DIM, slices=3)
    build_vectors(articles, store, embedder, dim=SEARCH_DIM)
    build_vectors(dated, store, embedder, FORCE, dim=SEARCH_DIM)
    return _stored_entries(store)


@query
def stream_ingest(t: Tables) -> DataFrame:
    """Three drops delivered twice; what is stored equals the batch result."""
    drops = scratch_path(t.spark, "drops")
    raw = t.raw()
    last, n = raw.agg(F.max("seq"), F.count("*")).first()
    third = (last or 0) // 3 + 1
    files = math.ceil(max(n, 1) / (3 * DROP_ROWS))
    for part in (0, 1, 2) * 2:
        # One after the other: files are taken in the order they were written. The rows of
        # a URL stay in one file of a drop, so no batch parts them.
        drop = raw.where(F.floor(F.col("seq") / third) == part)
        dealt = drop.coalesce(1) if files == 1 else drop.repartition(files, prepare.strip("link"))
        dealt.write.mode("append").parquet(drops)
    articles = ArticleStore(t.spark, scratch_path(t.spark, "articles"), BUCKETS)
    vectors = VectorStore(t.spark, scratch_path(t.spark, "vectors"))
    stream = read_drops(t.spark, drops, raw.schema, max_files=2 * files)
    start_ingest(
        stream, articles, vectors, embedder, scratch_path(t.spark, "progress"), SEARCH_DIM
    ).awaitTermination()
    return articles.read().select("id", "seq", "link").join(_stored_entries(vectors), "id", "left")


# --- search ---


def _search(t: Tables, **options) -> DataFrame:
    """Over stored articles and the vectors built from them."""
    articles = t.stored_articles()
    vectors = t.built_vectors(articles)
    return semantic_search(
        t.queries(), articles, vectors, embedder, buckets=BUCKETS, **options
    )


@query
def semantic_search_lexical(t: Tables) -> DataFrame:
    return _search(t)


@query
def semantic_search_passthrough(t: Tables) -> DataFrame:
    """Not reranked, and the content kept in a table of its own."""
    return _search(t, scorer="passthrough", content=t.articles(True).select("id", CONTENT_COLUMN))


@query
def search_as_list(t: Tables) -> DataFrame:
    return as_list_items(_search(t))


@query
def search_list_envelopes(t: Tables) -> DataFrame:
    return list_envelopes(t.queries(), _search(t))


class LengthScorer:
    """Longer passages first; refuses a query with a comma."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        if "," in query:
            raise ValueError("refused")
        return [float(len(p)) for p in passages]


def _rerank(t: Tables, scorer) -> DataFrame:
    checkpoint_dir(t.spark)
    asked = t.queries().where(~prepare.is_blank("query"))
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("query"))).first()
    articles = t.stored_articles()
    vectors = t.built_vectors(articles)
    hits = knn.knn_batch(vectors, embed.embed_queries(asked, embedder).checkpoint())
    return reranking.rerank(hits.checkpoint(), asked, articles, n * 30, size, scorer)


@query
def rerank_lexical(t: Tables) -> DataFrame:
    return _rerank(t, "lexical")


@query
def rerank_fallback(t: Tables) -> DataFrame:
    return _rerank(t, LengthScorer)


class ListScorer:
    """Scores by how many passages there are and by their place: one call must see all."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        return [float(len(passages) * 100 + n) for n in range(len(passages))]


@query
def rerank_listwise(t: Tables) -> DataFrame:
    return _rerank(t, ListScorer)


class ShapeScorer:
    """By the query's length: wrapped scores, one too few, or none that is a number."""

    def score(self, query: str, passages: list[str]) -> list:
        scores = [[{"score": float(len(p))}] for p in passages]
        kind = len(query) % 3
        return scores if kind == 0 else scores[1:] if kind == 1 else [float("nan")] * len(scores)


@query
def rerank_score_shapes(t: Tables) -> DataFrame:
    return _rerank(t, ShapeScorer)


@query
def content_lookup(t: Tables) -> DataFrame:
    """Content of the featured hundred."""
    wanted = listing.featured_news(t.articles(), 100).select("id")
    return hydrate.lookup_content(t.articles(True), wanted, 100)
