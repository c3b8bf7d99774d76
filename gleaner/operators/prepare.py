"""Raw article rows to prepared articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numbers import to_nullable_long
from gleaner.functions.text import fold, is_blank, stable_id, strip
from gleaner.schemas import CONTENT_COLUMN, REQUIRED_COLUMNS, require_columns

URL_KEY = "url_key"


def search_blob(title: Column, summary: Column) -> Column:
    empty = F.lit("")
    return fold(
        F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(summary, empty))
    )


def rejected_urls(raw: DataFrame) -> DataFrame:
    """Rows that cannot get an id: null or blank URL."""
    return require_columns(raw).where(is_blank("link"))


def keep_first(raw: DataFrame, order: str = "seq") -> DataFrame:
    """The earliest row of each stripped URL, with that URL as ``url_key``.

    ``row_number() = 1`` becomes a group limit that Spark also runs before the
    shuffle, so a URL holding a third of all rows reaches its reducer as one row per
    map task. Only the columns selected later are carried: read without content
    unless it is needed.
    """
    window = Window.partitionBy(URL_KEY).orderBy(order)
    return (
        raw.where(~is_blank("link"))
        .withColumn(URL_KEY, strip("link"))
        .withColumn("_nth", F.row_number().over(window))
        .where(F.col("_nth") == 1)
        .drop("_nth")
    )


def prepare_articles(raw: DataFrame, with_content: bool = True) -> DataFrame:
    """Check columns, drop repeats, add ``id`` and ``search_blob``, coerce comments.

    Needs a ``seq`` column that states the source order. ``id`` is computed from the
    partition key of the window, so a filter on ids reaches the rows before the
    shuffle.
    """
    require_columns(raw, [*REQUIRED_COLUMNS, "seq"])
    columns = ["seq", *REQUIRED_COLUMNS]
    if with_content and CONTENT_COLUMN in raw.columns:
        columns.append(CONTENT_COLUMN)
    kept = keep_first(raw.select(*columns))
    return kept.select(
        stable_id(URL_KEY).alias("id"),
        *[
            to_nullable_long(F.col(c)).alias(c) if c == "so_binh_luan" else F.col(c)
            for c in columns
        ],
        search_blob(F.col("tieu_de"), F.col("summary")).alias("search_blob"),
    )


def dedupe_report(raw: DataFrame) -> DataFrame:
    """One row: how many rows came in, were rejected, were kept, were repeats.

    Counts per URL are combined before the shuffle, so no URL is hot.
    """
    blank = is_blank("link")
    per_url = (
        raw.select(F.when(~blank, strip("link")).alias(URL_KEY))
        .groupBy(URL_KEY)
        .agg(F.count("*").alias("n"))
    )
    rejected = F.coalesce(F.sum(F.when(F.col(URL_KEY).isNull(), F.col("n"))), F.lit(0))
    unique = F.count(URL_KEY)
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_url.agg(
        total.alias("total_rows"),
        rejected.alias("rejected_rows"),
        unique.alias("kept_rows"),
        (total - rejected - unique).alias("dropped_rows"),
    )
