"""Checks between the article table and the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.bounds import anti_join_large, broadcast_if_bounded
from gleaner.operators.embed import points_to_embed
from gleaner.session import checkpoint_dir


def pending_ids(articles: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Articles without a vector, by id alone."""
    return articles.select("id").join(stored_ids.select("id"), "id", "left_anti")


def orphan_ids(stored_ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Vectors without an article."""
    return stored_ids.select("id").join(articles.select("id"), "id", "left_anti")


def pending_articles(
    articles: DataFrame, stored_ids: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Whole rows of the articles without a vector.

    For a delivery of at most ``max_rows`` articles the stored ids are only scanned.
    Otherwise ids alone are shuffled; the rows are then picked by a join with that id
    list, broadcast when it is small enough.
    """
    if max_rows is not None:
        return anti_join_large(articles, stored_ids, ["id"], max_rows, 16)
    checkpoint_dir(articles.sparkSession)
    ids = pending_ids(articles, stored_ids).checkpoint()
    return articles.join(broadcast_if_bounded(ids, ids.count(), 16), "id", "left_semi")


def index_audit(articles: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(metric, value) rows: coverage, orphans, repeats, empty texts, wrong dimensions.

    Ids of both sides meet in one aggregation whose partial sums run before the
    shuffle; the other counts are plain aggregates over narrow columns.
    """
    sides = articles.select("id", F.lit(1).alias("a"), F.lit(0).alias("v")).unionAll(
        vectors.select("id", F.lit(0), F.lit(1))
    )
    per_id = sides.groupBy("id").agg(F.sum("a").alias("a"), F.sum("v").alias("v"))
    coverage = per_id.agg(
        F.sum("a").alias("articles"),
        F.sum("v").alias("vectors"),
        F.count_if((F.col("a") > 0) & (F.col("v") > 0)).alias("covered"),
        F.count_if(F.col("v") == 0).alias("pending"),
        F.count_if(F.col("a") == 0).alias("orphans"),
        F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("repeated_article_ids"),
        F.sum(F.greatest(F.col("v") - 1, F.lit(0))).alias("repeated_vector_ids"),
    )
    texts = points_to_embed(articles).agg(
        F.count_if(F.col("text") == "").alias("empty_texts")
    )
    sizes = vectors.agg(F.count_if(F.size("vector") != dim).alias("wrong_dimension"))
    parts = [_as_rows(part) for part in (coverage, texts, sizes)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _as_rows(one_row: DataFrame) -> DataFrame:
    filled = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in one_row.columns]
    return one_row.select(*filled).unpivot([], one_row.columns, "metric", "value")
