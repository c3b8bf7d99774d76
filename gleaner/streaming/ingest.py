"""Crawl drops from a folder into the article and vector stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.embed import Embedder
from gleaner.operators.prepare import prepare_articles
from gleaner.plans.build_vectors import build_vectors
from gleaner.settings import VECTOR_DIM
from gleaner.sources.article_store import ArticleStore
from gleaner.sources.vector_store import VectorStore


def read_drops(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """Files as they arrive; ``max_files`` bounds one micro-batch."""
    stream = spark.readStream.format(file_format).schema(schema)
    return stream.option("maxFilesPerTrigger", max_files).load(path)


def ingest_batch(
    raw: DataFrame,
    articles: ArticleStore,
    vectors: VectorStore,
    factory: Callable[[], Embedder],
    dim: int = VECTOR_DIM,
) -> None:
    """One delivery: new articles first, then those of its articles without a vector.

    The stores are the state. A replayed delivery finds its articles stored, and the
    second step completes vectors that an earlier, broken attempt left out: it looks
    at the stored form of every article delivered, new or not. Both steps scan the
    stores without shuffling them.
    """
    batch = prepare_articles(raw).persist()
    try:
        n = batch.count()
        articles.append(articles.only_new(batch, n))
        build_vectors(articles.lookup(batch, n), vectors, factory, dim=dim, max_rows=n)
    finally:
        batch.unpersist()


def start_ingest(
    drops: DataFrame,
    articles: ArticleStore,
    vectors: VectorStore,
    factory: Callable[[], Embedder],
    checkpoint: str,
    dim: int = VECTOR_DIM,
) -> StreamingQuery:
    """Process everything there is, then stop; run again for the next drops."""
    return (
        drops.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, _: ingest_batch(df, articles, vectors, factory, dim))
        .start()
    )
