"""Hits to articles, and late content lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.bounds import broadcast_if_bounded, is_bounded, spread_hot
from gleaner.schemas import CONTENT_COLUMN

HIT_BYTES = 48
ID_BYTES = 24


def with_bucket(df: DataFrame, buckets: int | None) -> DataFrame:
    """Add the article store's partition column to rows with an id."""
    if buckets is None:
        return df
    return df.withColumn("bucket", F.pmod("id", F.lit(buckets)).cast("int"))


def join_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """``bucket`` too when both sides have it, so that the scan prunes partitions."""
    return [c for c in ("bucket", "id") if c in left.columns and c in right.columns]


def hydrate(
    hits: DataFrame,
    articles: DataFrame,
    max_hits: int,
    with_content: bool = False,
    content: DataFrame | None = None,
) -> DataFrame:
    """Attach article metadata to hits; hits without an article drop out.

    Order travels as ``rank``. ``max_hits`` is the proven bound (queries x k): within
    it the hits are broadcast and the articles are only scanned; beyond it each article
    is shuffled once. ``with_content`` takes the content from the same scan. Given
    ``content`` (id, noi_dung), it is looked up there and null where it is missing.

    Texts meet their hits last: the result has a copy for every hit, and is not shuffled.
    """
    fields = ["tieu_de", "summary", "link", "ngay_dang", "nguon"]
    own = [F.col(CONTENT_COLUMN).alias("content")] if with_content else []
    keys = join_keys(hits, articles)
    if content is not None and not is_bounded(max_hits, HIT_BYTES):
        keys = ["id"]  # all three sides are dealt alike, and none twice
    metadata = articles.select(*keys, *fields, *own)
    wanted = [c for c in hits.columns if c != "bucket" or c in keys]
    if is_bounded(max_hits, HIT_BYTES):
        if content is not None:
            ids = hits.select(*keys).distinct()
            ids = broadcast_if_bounded(ids, max_hits, ID_BYTES)
            found = lookup_content(content, hits, max_hits)
            metadata = metadata.join(ids, keys, "left_semi").join(found, "id", "left")
        met = metadata.join(F.broadcast(hits.select(*wanted)), keys)
    else:
        # Hot articles are known from the hits alone, so every side is salted alike.
        narrow = hits.select(*wanted)
        metadata, salted = spread_hot(metadata, narrow, keys, "query_id", max_hits)
        if content is not None:
            texts = content.select("id", F.col(CONTENT_COLUMN).alias("content"))
            texts, _ = spread_hot(texts, narrow, keys, "query_id", max_hits)
            metadata = metadata.join(texts, [*keys, "salt"], "left")
        met = metadata.join(salted, [*keys, "salt"])
    return met.select(
        *[c for c in hits.columns if c != "bucket"],
        *(["content"] if with_content or content is not None else []),
        F.col("tieu_de").alias("title"),
        "summary",
        F.col("link").alias("url"),
        F.lit(None).cast("string").alias("image"),
        F.col("ngay_dang").alias("date"),
        F.col("nguon").alias("source"),
    )


def lookup_content(content: DataFrame, ids: DataFrame, max_ids: int) -> DataFrame:
    """(id, content) for an id set; reads only the id and content columns.

    Left-join its result to keep ids without content. A left join with the content
    table itself cannot broadcast its left side and would shuffle all content.
    """
    keys = join_keys(ids, content)
    wanted = broadcast_if_bounded(ids.select(*keys).distinct(), max_ids, ID_BYTES)
    return content.join(wanted, keys, "left_semi").select(
        "id", F.col(CONTENT_COLUMN).alias("content")
    )
