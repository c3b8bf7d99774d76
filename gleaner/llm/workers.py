"""What every operator with code in Python workers asks of the session."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from gleaner.session import checkpoint_dir, ship_package

#: Texts are long; batches of many of them would make Python workers large.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Ship the package, know the checkpoint folder, keep Arrow batches small."""
    ship_package(spark)
    checkpoint_dir(spark)
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or int(now.rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name (in any case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path's name there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
