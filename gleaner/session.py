"""Session set-up and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. ``master`` is left alone when not given."""
    builder = (
        SparkSession.builder.appName("gleaner")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        base = base or tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, under the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/gleaner-{uuid.uuid4().hex}/{name}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "gleaner.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system; a failed read would do but leaves error noise."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
