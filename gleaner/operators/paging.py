"""Page arithmetic and ordered slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir
from gleaner.settings import MAX_PAGE_LIMIT, TOP_K_PAGE_ROWS


@dataclass(frozen=True)
class Page:
    page: int
    limit: int

    @staticmethod
    def clamp(page: int, limit: int) -> Page:
        return Page(max(1, page), max(1, min(limit, MAX_PAGE_LIMIT)))

    @property
    def start(self) -> int:
        return (self.page - 1) * self.limit


def slice_page(
    rows: DataFrame,
    sort_column: str,
    order: list,
    page: Page,
    top_k_rows: int = TOP_K_PAGE_ROWS,
) -> DataFrame:
    """Rows ``start .. start+limit`` of the given total order, with ``position``.

    First only ``id``, ``seq`` and the sort column are read (and, for articles still
    to be deduplicated, shuffled) to find which rows are on the page, at most
    ``MAX_PAGE_LIMIT`` of them. Then exactly these are fetched by an id filter, which
    reaches the scan, and by their buckets where rows have them.

    Early pages are found by a distributed top-k. A page ending beyond ``top_k_rows``
    would make every task and the driver hold that many rows, so deep pages are
    sorted by range and only the partitions the page falls into are looked at.
    """
    bucket = ["bucket"] if "bucket" in rows.columns else []
    keys = rows.select(*dict.fromkeys(["id", "seq", sort_column, *bucket]))
    if page.start + page.limit <= top_k_rows:
        picked = keys.orderBy(*order).offset(page.start).limit(page.limit)
        rows_found = enumerate(picked.collect())
        found = [(row["id"], row["seq"], nth, *(row[b] for b in bucket)) for nth, row in rows_found]
    else:
        found = _deep_page(keys, order, page, bucket)

    places = rows.sparkSession.createDataFrame(
        [row[:3] for row in found], "id bigint, seq bigint, position bigint"
    )
    wanted = rows.where(F.col("id").isin([row[0] for row in found]) if found else F.lit(False))
    if bucket and found:
        # Ids are hashes: only the partition column can keep other files unread.
        wanted = wanted.where(F.col("bucket").isin(sorted({row[3] for row in found})))
    return wanted.join(F.broadcast(places), ["id", "seq"]).orderBy("position")


def _deep_page(keys: DataFrame, order: list, page: Page, bucket: list[str]) -> list[tuple]:
    if keys.count() <= page.start:
        return []
    checkpoint_dir(keys.sparkSession)
    ranged = keys.repartitionByRange(*order)
    # Range bounds are sampled; the checkpoint pins them for the two passes below.
    ranged = ranged.withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()

    # Where each overlapping partition starts, relative to the page.
    starts, seen = {}, 0
    for part, n in sizes:
        if seen < page.start + page.limit and seen + n > page.start:
            starts[part] = seen - page.start
        seen += n
    if not starts:
        return []
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    begin = F.create_map([F.lit(x) for pair in starts.items() for x in pair])
    placed = (
        ranged.where(F.col("part").isin(list(starts)))
        .select("id", "seq", (begin[F.col("part")] + within).alias("position"), *bucket)
        .where(F.col("position").between(0, page.limit - 1))
    )
    return [tuple(row) for row in placed.collect()]


def envelope(rows: DataFrame, page: Page) -> DataFrame:
    """One row: total, page, limit, total_pages."""
    total = F.count("*")
    return rows.agg(
        total.alias("total"),
        F.lit(page.page).alias("page"),
        F.lit(page.limit).alias("limit"),
        F.greatest(F.lit(1), F.ceil(total / F.lit(page.limit)))
        .cast("bigint")
        .alias("total_pages"),
    )
