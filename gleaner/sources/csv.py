"""CSV article source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.schemas import CSV_SCHEMA

# The spellings of a missing value in a CSV field.
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_articles_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CSV_SCHEMA,
    multi_line: bool = True,
) -> DataFrame:
    """Article rows with a ``seq`` column for source order.

    Spark raises PATH_NOT_FOUND for a missing path. Quoted line breaks need
    ``multi_line``, which reads each file in one task: deliver large feeds as many
    files, or turn it off where fields hold no line breaks so that files split.
    Source order is the order of file paths, then of rows in a file. When the schema
    has a ``seq`` column the file supplies it.
    """
    rows = spark.read.csv(
        path,
        schema=schema,
        header=True,
        multiLine=multi_line,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    texts = {
        f.name: missing_to_null(f.name)
        for f in schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    if "seq" in rows.columns:
        return rows.withColumns(texts)
    return _in_source_order(rows).withColumns(texts)


# Bytes of a file and numbers of files that fit a ``seq`` together.
FILE_BITS = 43


def _in_source_order(rows: DataFrame) -> DataFrame:
    """Add ``seq`` from the file's place among the paths, the split's first byte and the
    row's place in its task. A task takes no more rows than a split has bytes, so splits
    of a file do not overlap."""
    names = rows.columns
    paths = F.col("_metadata.file_path")
    files = rows.select(paths.alias("path")).distinct()
    # One row per file; a task numbers them all.
    number = F.row_number().over(Window.orderBy("path")) - 1
    ordinals = files.withColumn("ordinal", number.cast("bigint"))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.select(
        *names,
        paths.alias("path"),
        (F.col("_metadata.file_block_start") + in_task).alias("place"),
    )
    seq = F.shiftleft("ordinal", FILE_BITS) + F.col("place")
    return placed.join(ordinals, "path").select(*names, seq.alias("seq"))


def missing_to_null(name: str):
    return F.when(~F.col(name).isin(NA_SPELLINGS), F.col(name))


def write_articles_csv(articles: DataFrame, path: str) -> None:
    """Counterpart of the reader: header, quotes doubled, nulls as empty fields."""
    articles.write.csv(
        path,
        header=True,
        escape='"',
        quoteAll=True,
        nullValue="NULL",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
