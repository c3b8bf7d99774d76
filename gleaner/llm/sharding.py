"""Contiguous shards of equal bytes from global prefix sums.

Every row gets a place in one global order: by ``group`` (high bits of the text's hash,
so equal texts stand side by side), ``part`` (bits of the id's hash, so that a text
with very many copies is still spread over many tasks), text hash, id. The totals of
all (group, part) cells form a table of fixed size; its running sum gives each cell
its first byte and first row, and a window inside the cell gives the rest. The shard
of a row follows from the byte at which it begins, so shards are runs of the order.
Only narrow columns are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPS = 512
PARTS = 64
ROW_OVERHEAD = 8


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes and the fixed overhead of a row; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, one row per input row.

    Shard s starts at the first row that begins at or after s/``shards`` of all bytes,
    so sizes differ from the target by less than one row. ``slot`` counts the rows of
    a shard in order, from 0. Null texts count as empty; null ids and repeated rows
    are rows like any other (rows alike in id and text take their slots in any order).
    An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        byte_size().alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ).select(
        "*",
        F.pmod(F.col("h"), F.lit(GROUPS)).cast("int").alias("group"),
        F.pmod(F.xxhash64("doc_id", "h"), F.lit(PARTS)).cast("int").alias("part"),
    )
    cells = rows.groupBy("group", "part").agg(
        F.sum("size").alias("cell_bytes"), F.count("*").alias("cell_rows")
    )
    # GROUPS * PARTS rows at most, whatever the input: one task sums them up.
    before = Window.orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = cells.select(
        "group",
        "part",
        F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("first_row"),
        F.sum("cell_bytes").over(every).alias("total_bytes"),
    )
    inside = Window.partitionBy("group", "part").orderBy("h", "doc_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("bytes_before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("rows_before", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["group", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(
                F.floor(
                    (F.col("first_byte") + F.col("bytes_before")).cast("decimal(20,0)")
                    * shards
                    / F.col("total_bytes")
                ),
                F.lit(shards - 1),
            )
            .cast("int")
            .alias("shard"),
            (F.col("first_row") + F.col("rows_before")).alias("row_no"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("row_no").alias("first_no"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("row_no") - F.col("first_no")).cast("long").alias("slot"),
    )
