"""Table layouts, as DDL where Spark accepts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Article columns as they arrive (fixed names of the source data).
REQUIRED_COLUMNS = [
    "nguon",
    "tieu_de",
    "ngay_dang",
    "tac_gia",
    "summary",
    "so_binh_luan",
    "link",
]
CONTENT_COLUMN = "noi_dung"

# Relational column -> article column.
NEWS_TABLE_COLUMNS = {
    "source": "nguon",
    "title": "tieu_de",
    "publish_date": "ngay_dang",
    "author": "tac_gia",
    "summary": "summary",
    "comments": "so_binh_luan",
    "url": "link",
}

CSV_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in [*REQUIRED_COLUMNS, CONTENT_COLUMN]]
)

PAYLOAD_DDL = "struct<id:bigint,title:string,summary:string,publish_date:string>"
VECTOR_DDL = f"id bigint, vector array<float>, payload {PAYLOAD_DDL}"
HITS_DDL = "query_id bigint, id bigint, score double"


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
