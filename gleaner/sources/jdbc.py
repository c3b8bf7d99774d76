"""Relational source: the ``news`` table, metadata without content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.schemas import NEWS_TABLE_COLUMNS

#: URLs of one IN list; longer lists are read in several.
PUSHED_URLS = 1000


def jdbc_options(
    url: str,
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    table: str = "news",
    key: str = "id",
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """A partitioned read over the table's serial key, one range per task."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower_bound),
        "upperBound": str(upper_bound),
        "numPartitions": str(num_partitions),
        "fetchsize": str(fetch_size),
        **extra,
    }


def read_news_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Metadata rows; only the selected columns travel, so content stays behind."""
    table = spark.read.format("jdbc").options(**options).load()
    return require_rows(articles_from_news(table, options["partitionColumn"]))


def articles_from_news(table: DataFrame, key: str = "id") -> DataFrame:
    """Rename to article columns; the date becomes ISO text, the serial key ``seq``."""
    columns = [
        F.date_format(F.col(db), "yyyy-MM-dd").alias(name)
        if name == "ngay_dang"
        else F.col(db).alias(name)
        for db, name in NEWS_TABLE_COLUMNS.items()
    ]
    return table.select(F.col(key).cast("bigint").alias("seq"), *columns)


def require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise RuntimeError("the news table has no rows")
    return rows


def content_by_urls(
    spark: SparkSession, options: dict[str, str], urls: list[str]
) -> DataFrame:
    """Content of the given articles: URLs are pushed to the database as IN lists."""
    return content_of(spark.read.format("jdbc").options(**options).load(), urls)


def content_of(table: DataFrame, urls: list[str]) -> DataFrame:
    """``url, content`` of the URLs, each list of ``PUSHED_URLS`` a read of its own."""
    distinct = list(dict.fromkeys(urls))
    reads = [
        table.where(F.col("url").isin(distinct[at : at + PUSHED_URLS]))
        for at in range(0, max(len(distinct), 1), PUSHED_URLS)
    ]
    return reduce(DataFrame.unionAll, reads).select("url", "content")
