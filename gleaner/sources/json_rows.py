"""JSON rows for a page of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(
    items: DataFrame, id_as_string: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """One ``json`` document per row, null fields included.

    ``id_as_string`` is for readers whose numbers cannot hold 60 bits.
    """
    if id_as_string:
        items = items.withColumn("id", F.col("id").cast("string"))
    keep = keep or []
    fields = [name for name in items.columns if name not in keep]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return items.select(*keep, document.alias("json"))


def write_json(items: DataFrame, path: str, id_as_string: bool = False) -> None:
    to_json_rows(items, id_as_string).write.text(path)
