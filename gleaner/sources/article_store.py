"""Prepared articles as Parquet, partitioned by a bucket of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.operators.bounds import broadcast_if_bounded
from gleaner.operators.hydrate import ID_BYTES, with_bucket
from gleaner.schemas import CONTENT_COLUMN
from gleaner.session import path_exists

ARTICLE_DDL = (
    "id bigint, seq bigint, nguon string, tieu_de string, ngay_dang string, "
    "tac_gia string, summary string, so_binh_luan bigint, link string, "
    f"{CONTENT_COLUMN} string, search_blob string"
)


class ArticleStore:
    """Append-only: an article once stored is kept (keep-first across deliveries).

    Ids are hashes, so buckets are even. Listing queries read a few columns and leave
    content alone; id lookups that carry ``bucket`` prune partitions.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        if path_exists(spark, f"{path}/layout"):
            stored = spark.read.schema("buckets int").parquet(f"{path}/layout").first()[0]
            if stored != buckets:
                raise ValueError(f"store has {stored} buckets, not {buckets}")

    def read(self) -> DataFrame:
        schema = ARTICLE_DDL + ", bucket int"
        if not path_exists(self.spark, f"{self.path}/data"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/data")

    def count(self) -> int:
        return self.read().count()

    def append(self, prepared: DataFrame) -> None:
        """Store prepared articles that are known to be new."""
        if CONTENT_COLUMN not in prepared.columns:
            prepared = prepared.withColumn(CONTENT_COLUMN, F.lit(None).cast("string"))
        columns = [c.split()[0] for c in ARTICLE_DDL.split(", ")]
        if not path_exists(self.spark, f"{self.path}/layout"):
            layout = self.spark.createDataFrame([(self.buckets,)], "buckets int")
            layout.coalesce(1).write.parquet(f"{self.path}/layout")
        rows = with_bucket(prepared.select(*columns), self.buckets)
        # One writer per bucket (more for a large one) instead of every task writing
        # every bucket.
        rows.hint("rebalance", "bucket").write.mode("append").partitionBy(
            "bucket"
        ).parquet(f"{self.path}/data")

    def only_new(self, prepared: DataFrame, max_rows: int) -> DataFrame:
        """Rows whose URL is not stored yet.

        The store side is reduced to the batch's ids first (broadcast within the
        bound, with partition pruning), then compared by URL: two URLs may share an
        id, and must not hide each other.
        """
        known = self.lookup(prepared, max_rows).select("id", strip("link").alias("url_key"))
        return (
            prepared.withColumn("url_key", strip("link"))
            .join(known, ["id", "url_key"], "left_anti")
            .drop("url_key")
        )

    def lookup(self, wanted: DataFrame, max_rows: int) -> DataFrame:
        """Stored rows of at most ``max_rows`` ids."""
        ids = with_bucket(wanted.select("id").distinct(), self.buckets)
        keys = broadcast_if_bounded(ids, max_rows, ID_BYTES)
        return self.read().join(keys, ["bucket", "id"], "left_semi")
