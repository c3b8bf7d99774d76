"""Listing queries over prepared articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import fold, strip
from gleaner.operators.paging import Page, envelope, slice_page
from gleaner.settings import (
    DEFAULT_PAGE_LIMIT,
    FEATURED_LIMIT,
    OTHER_CATEGORY,
    UNKNOWN_AUTHOR,
    UNTITLED,
)

# The public field names of a list item.
ITEM_COLUMNS = {
    "id": "id",
    "tieu_de": "title",
    "ngay_dang": "publish_date",
    "tac_gia": "author",
    "nguon": "source",
    "link": "url",
    "so_binh_luan": "comments",
    "summary": "summary",
}
ITEM_FIELDS = [*ITEM_COLUMNS.values(), "image"]


def news_items(articles: DataFrame, *extra: str) -> DataFrame:
    """Article columns to the public list item."""
    columns = [F.col(raw).alias(name) for raw, name in ITEM_COLUMNS.items()]
    return articles.select(*columns, F.lit(None).cast("string").alias("image"), *extra)


def _page(articles: DataFrame, sort_column: str, order: list, page: Page) -> DataFrame:
    extra = ["seq", "bucket"] if "bucket" in articles.columns else ["seq"]
    return slice_page(news_items(articles, *extra), sort_column, order, page).select(
        *ITEM_FIELDS, "position"
    )


def latest_news(
    articles: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT
) -> DataFrame:
    """Newest first by ISO date text, undated last, id decides ties."""
    order = [F.desc_nulls_last("publish_date"), F.asc("id")]
    return _page(articles, "publish_date", order, Page.clamp(page, limit))


def latest_envelope(
    articles: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT
) -> DataFrame:
    return envelope(articles, Page.clamp(page, limit))


def featured_news(articles: DataFrame, limit: int = FEATURED_LIMIT) -> DataFrame:
    """Most commented first, uncounted last, id decides ties."""
    order = [F.desc_nulls_last("comments"), F.asc("id")]
    return _page(articles, "comments", order, Page.clamp(1, limit))


def featured_envelope(articles: DataFrame, limit: int = FEATURED_LIMIT) -> DataFrame:
    """Page 1 with the total over all articles."""
    return envelope(articles, Page.clamp(1, limit))


def category_name() -> Column:
    return F.coalesce(F.col("nguon"), F.lit(OTHER_CATEGORY))


def categories(articles: DataFrame) -> DataFrame:
    return (
        articles.groupBy(category_name().alias("name"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("name"))
    )


def category_total(articles: DataFrame) -> DataFrame:
    """Number of categories (not of articles)."""
    return articles.agg(F.count_distinct(category_name()).alias("total"))


def keyword_matches(articles: DataFrame, query: str) -> DataFrame:
    """Literal substring match of the folded query in the folded title and summary."""
    folded = fold(strip(F.lit(query)))
    return articles.where((folded != "") & F.contains(F.col("search_blob"), folded))


def keyword_search(
    articles: DataFrame, query: str, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT
) -> DataFrame:
    """One page of matches in source order."""
    matched = keyword_matches(articles, query)
    return _page(matched, "seq", [F.asc("seq")], Page.clamp(page, limit))


def keyword_envelope(
    articles: DataFrame, query: str, page: int = 1, limit: int = DEFAULT_PAGE_LIMIT
) -> DataFrame:
    totals = envelope(keyword_matches(articles, query), Page.clamp(page, limit))
    return totals.select(F.lit(query).alias("query"), "*")


def page_document(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Envelope and items nested into one row; a page holds at most 100 items."""
    fields = [c for c in items.columns if c != "position"]
    listed = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("item"))))
    nested = items.agg(F.transform(listed, lambda e: e["item"]).alias("items"))
    return totals.withColumn("items", nested.scalar())


def category_document(articles: DataFrame) -> DataFrame:
    """Category envelope: number of categories and the list, one row."""
    entry = F.struct((-F.col("count")).alias("order"), "name", "count")
    listed = F.array_sort(F.collect_list(entry))
    return categories(articles).agg(
        F.count("*").alias("total"),
        F.transform(
            listed, lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"))
        ).alias("items"),
    )


def display_items(items: DataFrame) -> DataFrame:
    """Card texts: dd/MM/yyyy dates, placeholders for a missing author or title."""
    date = F.col("publish_date")
    shown = F.date_format(F.try_to_timestamp(date), "dd/MM/yyyy")
    return items.withColumns(
        {
            "publish_date": F.coalesce(shown, date, F.lit("")),
            "author": F.coalesce("author", F.lit(UNKNOWN_AUTHOR)),
            "title": F.coalesce("title", F.lit(UNTITLED)),
        }
    )
