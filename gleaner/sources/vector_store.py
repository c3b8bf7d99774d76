"""Vector points as Parquet batches with a commit log.

A write lands in a folder of its own attempt and counts only once its log row is there,
so a crashed write leaves no trace in reads, and two writers do not overwrite each other.
``recreate`` and ``compact`` start a new generation and leave the old files to
whoever is still reading them.
"""

from __future__ import annotations

import uuid
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.bounds import broadcast_if_bounded
from gleaner.schemas import VECTOR_DDL
from gleaner.session import path_exists

LOG_DDL = (
    "generation int, batch int, kind string, dim int, row_count bigint, attempt string"
)
CREATE, APPEND, REPLACE = "create", "append", "replace"


@dataclass(frozen=True)
class Commit:
    generation: int
    batch: int
    kind: str
    dim: int
    row_count: int
    attempt: str = ""


class VectorStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # --- log ---

    def _commits(self) -> list[Commit]:
        """Commits of the current generation. The log has one small row per write."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return []
        log = self.spark.read.schema(LOG_DDL).parquet(f"{self.path}/log")
        commits = [Commit(*row) for row in log.collect()]
        if not commits:  # a crash before the first row was there
            return []
        latest = max(c.generation for c in commits)
        current = (c for c in commits if c.generation == latest)
        return sorted(current, key=lambda c: (c.batch, c.attempt))

    def _commit(self, commit: Commit) -> None:
        row = astuple(commit)
        log = self.spark.createDataFrame([row], LOG_DDL).coalesce(1)
        log.write.mode("append").parquet(f"{self.path}/log")

    def _folder(self, generation: int, batch: int, attempt: str) -> str:
        return f"{self.path}/data/generation={generation}/batch={batch}/attempt={attempt}"

    # --- life cycle ---

    def exists(self) -> bool:
        return bool(self._commits())

    def dim(self) -> int | None:
        commits = self._commits()
        return commits[0].dim if commits else None

    def ensure(self, dim: int) -> None:
        """Create when absent; never touch what is there."""
        current = self.dim()
        if current is None:
            self._commit(Commit(0, 0, CREATE, dim, 0))
        elif current != dim:
            raise ValueError(f"store holds dimension {current}, not {dim}")

    def recreate(self, dim: int) -> None:
        """Start over empty."""
        commits = self._commits()
        generation = commits[0].generation + 1 if commits else 0
        self._commit(Commit(generation, 0, CREATE, dim, 0))

    # --- reads ---

    def _rows(self, commits: list[Commit]) -> DataFrame:
        folders = [
            self._folder(c.generation, c.batch, c.attempt) for c in commits if c.row_count
        ]
        schema = VECTOR_DDL + ", generation int, batch int, attempt string"
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*folders)

    def read(self) -> DataFrame:
        """(id, vector, payload), the latest write of each id.

        Plain appends need no resolution. Replacing writes are resolved by joining their
        ids. Beyond the broadcast bound that join shuffles the vectors; ``compact``, which
        a forced build of most of the store calls, takes it off later reads.
        """
        commits = self._commits()
        rows = self._rows(commits)
        replacing = [c for c in commits if c.kind == REPLACE]
        if replacing:
            write = F.struct("batch", "attempt")
            newest = self._rows(replacing).groupBy("id").agg(F.max(write).alias("newest"))
            bound = sum(c.row_count for c in replacing)
            rows = rows.join(broadcast_if_bounded(newest, bound, 72), "id", "left").where(
                F.col("newest").isNull() | (write >= F.col("newest"))
            )
        return rows.select("id", "vector", "payload")

    def ids(self) -> DataFrame:
        """Stored ids; vectors and payloads are not read."""
        commits = self._commits()
        ids = self._rows(commits).select("id")
        return ids.distinct() if any(c.kind == REPLACE for c in commits) else ids

    def count(self) -> int:
        commits = self._commits()
        if any(c.kind == REPLACE for c in commits):
            return self.ids().count()
        return sum(c.row_count for c in commits)

    # --- writes ---

    def upsert(
        self,
        points: DataFrame,
        replace: bool = True,
        unique: bool = False,
        order: str | None = None,
    ) -> int:
        """Insert points, or replace those whose id is stored; returns rows written.

        ``replace=False`` is for ids known to be new, ``unique=True`` for points known
        to hold each id once (both are so in a build); either saves work. Of several
        points with one id the one with the largest ``order`` is kept (the later one of a
        stream of points); without that column it is not defined which.
        """
        commits = self._commits()
        if not commits:
            raise ValueError("the store does not exist; call ensure first")
        if not unique and order:
            last_one = F.max_by(F.struct("vector", "payload"), order).alias("p")
            points = points.groupBy("id").agg(last_one).select("id", "p.vector", "p.payload")
        elif not unique:
            points = points.dropDuplicates(["id"])
        last = commits[-1]
        attempt = uuid.uuid4().hex
        folder = self._folder(last.generation, last.batch + 1, attempt)
        self._checked(points, last.dim).write.parquet(folder)
        written = self.spark.read.schema(VECTOR_DDL).parquet(folder).count()
        kind = REPLACE if replace else APPEND
        self._commit(
            Commit(last.generation, last.batch + 1, kind, last.dim, written, attempt)
        )
        return written

    def compact(self) -> None:
        """Fold all batches into one, in a new generation."""
        commits = self._commits()
        if not commits:
            return
        generation, dim = commits[0].generation + 1, commits[0].dim
        attempt = uuid.uuid4().hex
        folder = self._folder(generation, 1, attempt)
        self.read().write.parquet(folder)
        written = self.spark.read.schema(VECTOR_DDL).parquet(folder).count()
        self._commit(Commit(generation, 1, APPEND, dim, written, attempt))

    def _checked(self, points: DataFrame, dim: int) -> DataFrame:
        size = F.size("vector")
        problem = F.concat(
            F.lit("vector of dimension "), size.cast("string"), F.lit(f", expected {dim}")
        )
        vector = F.when(size == dim, F.col("vector")).otherwise(F.raise_error(problem))
        return points.select("id", vector.alias("vector"), "payload")
