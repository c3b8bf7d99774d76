"""Cosine nearest neighbours.

Scores are rounded once, before threshold and ranking, and ties go to the lower id,
so every path returns the same rows whatever the summation order.

* ``knn_one``: one query vector, column expressions only, top-k plan.
* ``knn_batch``: many queries; matrix products inside the tasks, exact.
* ``knn_grid``: more queries than one block; both sides meet in groups, exact.
* ``knn_lsh``: as ``knn_grid`` but only against the cells a query probes.

No pair is ever emitted: only the k best rows of a query and task or group leave it. One
block of queries is shipped to the tasks and the corpus stays where it is. More queries
never pass the driver: a task holds a part of the corpus rows (bounded) and a lane of the
queries streams past it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.vectors import cosine
from gleaner.operators.bounds import broadcast_if_bounded
from gleaner.schemas import HITS_DDL
from gleaner.session import checkpoint_dir, ship_package
from gleaner.settings import BROADCAST_LIMIT_BYTES, CANDIDATE_K, QUERY_BLOCK_ROWS

MICRO = 10**6  # scores are held as whole millionths
NO_SCORE = -2 * MICRO
LAST_ID = np.iinfo(np.int64).max
ROWS_PER_STEP = 1024  # corpus rows and queries scored at once
QUERIES_PER_STEP = 2048
MERGE_TASKS = 512  # lists per query that one task merges
LISTED_CELLS = 4096
GROUP_BYTES = 128 << 20  # corpus rows that a task holds, as doubles
TASKS_PER_CORE = 3
#: Products that make a task worth its start, and those that are enough for one.
LEAST_WORK, MOST_WORK = 1 << 32, 1 << 40
LANE_ROWS = 1 << 16  # queries of a cell that one task takes
TASK_ROWS = 1 << 17  # rows and queries that a task of several cells takes


def knn_one(
    corpus: DataFrame,
    query_vector: Column,
    k: int = CANDIDATE_K,
    threshold: float | None = None,
) -> DataFrame:
    """(id, score) of the k nearest rows to one vector (a literal or scalar subquery)."""
    # Column first: a subquery may not stand inside a higher-order function.
    paired = corpus.select("id", "vector", query_vector.alias("wanted"))
    score = cosine(F.col("vector"), F.col("wanted")).alias("score")
    scored = paired.select("id", score)
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_K,
    threshold: float | None = None,
    block_rows: int = QUERY_BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, score, rank): exact, for a table of query vectors."""
    spark = corpus.sparkSession
    ship_package(spark)
    head = queries.select("query_id", "vector").limit(block_rows + 1).toArrow()
    if not head.num_rows:
        return spark.createDataFrame([], HITS_DDL + ", rank int")
    if head.num_rows > block_rows or head.nbytes > BROADCAST_LIMIT_BYTES:
        return knn_grid(corpus, queries, k, threshold)
    block = QueryBlock(head["query_id"].to_numpy(), to_matrix(_whole(head["vector"])))
    shared = spark.sparkContext.broadcast(block)
    hits = corpus.select("id", "vector").mapInArrow(_scorer(shared, k, threshold), HITS_DDL)
    return top_k_per_query(hits, k, corpus.rdd.getNumPartitions())


def knn_grid(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = CANDIDATE_K,
    threshold: float | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """As ``knn_batch`` for any number of queries, none of which passes the driver.

    The corpus is dealt into groups of about ``group_bytes``. Of g groups, the first √g are
    searched by all queries alone; the k-th score found there is a floor that a row of the
    other groups must reach, so that far less than k rows per task leave them.

    Each of both rounds is a grid of tasks: as many parts of the corpus as its size in
    memory needs, groups or not, by as many lanes of queries as the work needs. A row is
    sent once per lane and a query once per part.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    n, width = corpus.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 1
    groups = max(1, math.ceil(n * 8 * width / group_bytes))
    first = math.ceil(math.sqrt(groups))
    held = F.pmod(F.xxhash64("id"), F.lit(groups))
    rows = corpus.select(held.alias("group"), "id", "vector")
    asked = queries.select(F.col("query_id").alias("id"), "vector")
    n_asked = max(asked.count(), 1)
    cores = spark.sparkContext.defaultParallelism

    def search(floors: DataFrame, start: int, stop: int) -> tuple[DataFrame, int]:
        n_rows = n * (stop - start) / groups
        parts, lanes = _grid(n_rows, n_asked, width, TASKS_PER_CORE * cores)
        here = rows.where(F.col("group").between(start, stop - 1)).select(
            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).alias("part"),
            F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
            "id",
            "vector",
        )
        there = floors.select(
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
            F.pmod(F.xxhash64("id"), F.lit(lanes)).alias("lane"),
            "id",
            "vector",
            "floor",
        )
        task = (F.col("part") * lanes + F.col("lane")).cast("int")
        both = _sides(here, there, F.lit(0))
        dealt = both.withColumn("task", task).repartitionById(parts * lanes, "task")
        return _stream_past(dealt, k, threshold), parts

    no_floor = F.lit(None).cast("double").alias("floor")
    hits, parts = search(asked.select("*", no_floor), 0, first)
    sampled = top_k_per_query(hits, k, parts)
    if first == groups:
        return sampled
    sampled = sampled.checkpoint()
    worst = sampled.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("floor")
    )
    rest, parts = search(asked.join(worst, "id", "left"), first, groups)
    return top_k_per_query(sampled.drop("rank").unionByName(rest), k, parts + 1)


def _grid(n_rows: float, n_queries: int, width: int, most_tasks: int) -> tuple[int, int]:
    """Parts of the corpus and lanes of queries that make a round's grid.

    No part is larger than ``GROUP_BYTES``. There are ``most_tasks`` cells where the work is
    worth them, more where a cell would have too much; as square as the sides allow, with
    fewer parts, since the hits of every part leave it.
    """
    work = n_rows * n_queries * width
    tasks = max(min(most_tasks, math.ceil(work / LEAST_WORK)), math.ceil(work / MOST_WORK), 1)
    parts = max(
        math.ceil(n_rows * 8 * width / GROUP_BYTES),
        math.floor(math.sqrt(tasks * n_rows / (2 * n_queries))),
        1,
    )
    return min(parts, max(tasks, math.ceil(n_rows * 8 * width / GROUP_BYTES))), max(
        math.ceil(tasks / parts), 1
    )


def knn_lsh(
    index: DataFrame,
    queries: DataFrame,
    planes: np.ndarray,
    probes: int,
    k: int = CANDIDATE_K,
    threshold: float | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Approximate: score only index rows whose cell is among a query's best probes.

    ``index`` has ``cell`` from :func:`with_cell`; when it is a partition column, the
    scan reads only cells some query probes. Tasks find the cells of their queries, and
    queries and rows meet by cell; a cell of more than ``group_bytes`` is split into parts,
    each of which meets all queries of the cell. ``probes = 2**bits`` is exact.
    """
    spark = index.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    kind = queries.schema["vector"].dataType.simpleString()
    probed = queries.select("query_id", "vector").mapInArrow(
        _prober(planes, probes), f"id bigint, vector {kind}, cells array<bigint>"
    )
    probed = probed.checkpoint()
    asked = probed.select(F.explode("cells").alias("cell"), "id", "vector")
    wanted = asked.groupBy("cell").agg(F.count("*").alias("n_asked"))
    n_cells = wanted.count()
    if n_cells <= LISTED_CELLS:
        # As values they keep the folders of other cells unread.
        rows = index.where(F.col("cell").isin([row["cell"] for row in wanted.collect()]))
    else:
        rows = index.join(
            broadcast_if_bounded(wanted.select("cell"), n_cells, 32), "cell", "left_semi"
        )
    rows = rows.select(F.col("cell").cast("long").alias("cell"), "id", "vector")
    most = max(1, group_bytes // (8 * planes.shape[1]))
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    lanes = F.ceil(F.col("n_asked") / F.lit(LANE_ROWS)).cast("int")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).join(wanted, "cell")
    sizes = sizes.withColumns({"parts": parts, "lanes": lanes})
    streamed, groups = sizes.agg(
        F.sum(F.col("n") * F.col("lanes") + F.col("n_asked") * F.col("parts")),
        F.sum(F.col("parts") * F.col("lanes")),
    ).first()
    large = sizes.where("parts > 1 OR lanes > 1").select("cell", "parts", "lanes").checkpoint()
    n_large = large.count()

    def split(df: DataFrame) -> DataFrame:
        told = df.join(broadcast_if_bounded(large, n_large, 32), "cell", "left")
        one = F.lit(1)
        return told.withColumns(
            {"parts": F.coalesce("parts", one), "lanes": F.coalesce("lanes", one)}
        )

    nth = F.xxhash64("id")
    here = split(rows).select(
        "cell",
        F.pmod(nth, F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
        "id",
        "vector",
    )
    there = split(asked).select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(nth, F.col("lanes")).alias("lane"),
        "id",
        "vector",
        F.lit(None).cast("double").alias("floor"),
    )
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(groups or 1, given), math.ceil((streamed or 0) / TASK_ROWS))
    dealt = _sides(here, there, F.col("cell")).repartition(tasks, "cell", "part", "lane")
    return top_k_per_query(_stream_past(dealt, k, threshold), k)


def _sides(rows: DataFrame, queries: DataFrame, cell: Column) -> DataFrame:
    """``rows`` and ``queries`` of groups named by (cell, part, lane), as one table.

    Vectors stay floats where both sides have floats: half the bytes to send and hold.
    """
    kinds = {df.schema["vector"].dataType.simpleString() for df in (rows, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"

    def side(df: DataFrame, number: int, floor: Column) -> DataFrame:
        return df.select(
            cell.cast("long").alias("cell"),
            F.col("part").cast("long").alias("part"),
            F.col("lane").cast("long").alias("lane"),
            F.lit(number).alias("side"),
            "id",
            F.col("vector").cast(kind).alias("vector"),
            floor.alias("floor"),
        )

    return side(rows, 0, F.lit(None).cast("double")).unionByName(side(queries, 1, F.col("floor")))


def _stream_past(dealt: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Hits of the queries among the rows of their group, from what :func:`_sides` made.

    A task takes its groups one after the other.
    """
    ordered = dealt.select("cell", "part", "lane", "side", "id", "vector", "floor")
    ordered = ordered.sortWithinPartitions("cell", "part", "lane", "side")
    return ordered.mapInArrow(_grid_scorer(k, threshold), HITS_DDL)


def top_k_per_query(hits: DataFrame, k: int, tasks: int = 0) -> DataFrame:
    """Rank per query; the group limit also runs before the shuffle.

    The lists of more than ``MERGE_TASKS`` tasks are first merged in parts of a query, so
    that no single task meets all of them.
    """
    if tasks > MERGE_TASKS:
        parts = F.pmod(F.spark_partition_id(), F.lit(-(-tasks // MERGE_TASKS)))
        part = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), F.asc("id"))
        hits = hits.withColumn("part", parts).withColumn("rank", F.row_number().over(part))
        hits = hits.where(F.col("rank") <= k).drop("part", "rank")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


# --- cells -----------------------------------------------------------------------


def random_planes(bits: int, dim: int, seed: int = 0) -> np.ndarray:
    """Hyperplanes through the origin; the signs of the projections name the cell."""
    if not 1 <= bits <= 62:
        raise ValueError("bits must be between 1 and 62")
    return np.random.default_rng(seed).standard_normal((bits, dim))


def with_cell(corpus: DataFrame, planes: np.ndarray) -> DataFrame:
    """Add ``cell``; write the result partitioned by it to make probes prune files."""
    ship_package(corpus.sparkSession)

    def assign(vectors: pa.Array) -> pa.Array:
        return pa.array(cell_of(to_matrix(vectors, planes.shape[1]), planes), pa.int64())

    assign.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(assign, T.LongType())
    return corpus.withColumn("cell", udf(F.col("vector")))


def write_cells(corpus: DataFrame, planes: np.ndarray, path: str) -> None:
    """Store the corpus partitioned by cell; a large cell gets several writers."""
    cells = with_cell(corpus, planes).hint("rebalance", "cell")
    cells.write.partitionBy("cell").parquet(path)


def cell_of(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    bits = matrix @ planes.T > 0
    return (bits * (1 << np.arange(len(planes), dtype=np.int64))).sum(axis=1)


def best_cells(projected: np.ndarray, probes: int) -> list[int]:
    """The cells that cost a query least, cheapest first, its own before all.

    Crossing a hyperplane costs the squared distance to it. Sets of planes to cross come
    out of a heap by their cost: with planes ordered by distance, each set leads to the one
    with its farthest plane replaced by the next and the one with the next added.
    """
    own = sum(1 << int(bit) for bit in np.flatnonzero(projected > 0))
    order = np.argsort(np.abs(projected), kind="stable")
    cost = (projected[order] ** 2).tolist()
    flips = [1 << int(bit) for bit in order]
    cells, heap = [own], [(cost[0], 0, flips[0])]
    while heap and len(cells) < probes:
        total, last, mask = heapq.heappop(heap)
        cells.append(own ^ mask)
        if last + 1 < len(flips):
            added = total + cost[last + 1]
            heapq.heappush(heap, (added, last + 1, mask | flips[last + 1]))
            swapped = mask ^ flips[last] | flips[last + 1]
            heapq.heappush(heap, (added - cost[last], last + 1, swapped))
    return cells


def _prober(planes: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = to_matrix(batch.column(1), planes.shape[1])
            cells = [best_cells(projected, probes) for projected in matrix @ planes.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64()))],
                names=["id", "vector", "cells"],
            )

    return run


# --- query blocks ----------------------------------------------------------------


@dataclass
class QueryBlock:
    ids: np.ndarray
    vectors: np.ndarray


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def to_matrix(vectors: pa.Array, dim: int | None = None, kind=np.float64) -> np.ndarray:
    """List array to a matrix, of doubles if not told otherwise (None: as given); rows of
    unequal length are an error."""
    if not len(vectors):
        return np.zeros((0, dim or 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or lengths.min() != lengths.max():
        raise ValueError("vectors are missing or differ in dimension")
    if dim is not None and lengths[0] != dim:
        raise ValueError(f"vectors of dimension {lengths[0]}, expected {dim}")
    return flat.astype(kind or flat.dtype).reshape(len(vectors), -1)


# --- in the tasks ----------------------------------------------------------------


class BestRows:
    """The k best (score, id) rows of each query seen so far."""

    def __init__(
        self,
        n_queries: int,
        k: int,
        threshold: float | None = None,
        floors: np.ndarray | None = None,
    ) -> None:
        self.k = k
        self.threshold = threshold
        # Whole millionths that a row of each query must reach.
        self.floors = np.full(n_queries, NO_SCORE, np.int64) if floors is None else floors
        self.scores = np.full((n_queries, k), NO_SCORE, np.int64)
        self.ids = np.full((n_queries, k), LAST_ID, np.int64)

    def cutoff(self, rows: np.ndarray, dim: int) -> np.ndarray:
        """Single-precision cosines below this cannot enter.

        The slack is one unit for the rounding of scores and the error bound of a
        single-precision product of two unit vectors.
        """
        floor = self.floors[rows]
        if self.threshold is not None:
            floor = np.maximum(floor, self.threshold * MICRO)
        lowest = (np.maximum(self.scores[rows, -1], floor) - 1) / MICRO
        return (lowest - (dim + 4) * 2.0**-23).astype(np.float32)

    def add_all(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge a full block of ``scores`` (query x corpus row); ``ids`` must ascend."""
        n = len(ids)
        if n > self.k:
            # Score and position in one integer, so that ties fall to the lower id.
            keys = scores * n + np.arange(n - 1, -1, -1)
            picked = np.argpartition(keys, n - self.k, axis=1)[:, n - self.k :]
            self._merge(rows, np.take_along_axis(scores, picked, axis=1), ids[picked])
        else:
            self._merge(rows, scores, np.broadcast_to(ids, scores.shape))

    def add_some(
        self, rows: np.ndarray, nth: np.ndarray, scores: np.ndarray, ids: np.ndarray
    ) -> None:
        """Merge single cells; ``nth`` ascends and says which of ``rows`` each is for."""
        counts = np.bincount(nth, minlength=len(rows))
        active = np.nonzero(counts)[0]
        counts = counts[active]
        shape = (len(active), counts.max())
        places = np.arange(len(nth)) - np.repeat(np.cumsum(counts) - counts, counts)
        lines = np.repeat(np.arange(len(active)), counts)
        wide_scores = np.full(shape, NO_SCORE, np.int64)
        wide_ids = np.full(shape, LAST_ID, np.int64)
        wide_scores[lines, places] = scores
        wide_ids[lines, places] = ids
        self._merge(rows[active], wide_scores, wide_ids)

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        values = self.scores / MICRO
        keep = (self.scores > NO_SCORE) & (self.scores >= self.floors[:, None])
        if self.threshold is not None:
            keep &= values >= self.threshold
        rows, places = np.nonzero(keep)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[rows], pa.int64()),
                pa.array(self.ids[rows, places], pa.int64()),
                pa.array(values[rows, places], pa.float64()),
            ],
            names=["query_id", "id", "score"],
        )


def micro_cosine(products: np.ndarray, squared_norms: np.ndarray) -> np.ndarray:
    """Cosines in whole millionths, halves away from zero; zero vectors score 0.

    ``squared_norms`` is the product of both squared norms.
    """
    scale = np.sqrt(squared_norms)
    exact = np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)
    exact *= MICRO
    return np.trunc(exact + np.copysign(0.5, exact)).astype(np.int64)


class PreparedQueries:
    """A query block with what every task derives from it once."""

    def __init__(self, block: QueryBlock) -> None:
        self.ids, self.vectors = block.ids, block.vectors
        self.squared, self.unit = _squared_and_unit(block.vectors)

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]


def _squared_and_unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths and single-precision unit vectors; floats become doubles by steps."""
    squared, unit = np.zeros(len(matrix)), np.empty(matrix.shape, np.float32)
    for start in range(0, len(matrix), ROWS_PER_STEP):
        step = slice(start, start + ROWS_PER_STEP)
        exact = matrix[step].astype(np.float64, copy=False)
        squared[step] = np.einsum("ij,ij->i", exact, exact)
        norms = np.sqrt(squared[step])
        unit[step] = exact / np.where(norms == 0, 1, norms)[:, None]
    return squared, unit


class PreparedRows:
    """Corpus rows in order of their ids, with what scoring derives from them once.

    Vectors may be floats; scores are made from doubles all the same.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], matrix[order]
        self.squared, self.unit = _squared_and_unit(self.vectors)


def score_into(
    best: BestRows, picked: np.ndarray, queries: PreparedQueries, rows: PreparedRows
) -> None:
    """Score some queries against some rows, a bounded number of cells at a time.

    A single-precision product of unit vectors tells which cells can still enter. After the
    first rows these are few, and only they get their exact score. Where many qualify (the
    first rows, or masses of equal vectors) the whole block is scored and cut instead.
    """
    for start in range(0, len(rows.ids), ROWS_PER_STEP):
        step = slice(start, start + ROWS_PER_STEP)
        for first in range(0, len(picked), QUERIES_PER_STEP):
            part = picked[first : first + QUERIES_PER_STEP]
            near = queries.unit[part] @ rows.unit[step].T >= best.cutoff(part, queries.dim)[:, None]
            hits = np.count_nonzero(near)
            if hits > near.size // 16:
                products = queries.vectors[part] @ rows.vectors[step].astype(np.float64, copy=False).T
                norms = queries.squared[part][:, None] * rows.squared[step][None, :]
                best.add_all(part, micro_cosine(products, norms), rows.ids[step])
            elif hits:
                nth, row = np.nonzero(near)
                row += start
                asked = part[nth]
                wanted = rows.vectors[row].astype(np.float64, copy=False)
                products = np.einsum("ij,ij->i", queries.vectors[asked], wanted)
                scores = micro_cosine(products, queries.squared[asked] * rows.squared[row])
                best.add_some(part, nth, scores, rows.ids[row])


def _scorer(shared, k: int, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = PreparedQueries(shared.value)
        best = BestRows(len(queries.ids), k, threshold)
        everyone = np.arange(len(queries.ids))
        for batch in batches:
            matrix = to_matrix(batch.column(1), queries.dim)
            score_into(best, everyone, queries, PreparedRows(batch.column(0).to_numpy(), matrix))
        yield best.batch(queries.ids)

    return run


def _grid_scorer(k: int, threshold: float | None):
    """Rows come sorted by group, the corpus rows of a group before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, rows = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if tuple(keys[a, :3]) != group:
                    group, parts, rows = tuple(keys[a, :3]), [], None
                part = batch.slice(a, b - a)
                ids = part.column(4).to_numpy()
                if keys[a, 3] == 0:
                    parts.append((ids, to_matrix(part.column(5), kind=None)))
                    continue
                matrix = to_matrix(part.column(5))
                if parts:
                    rows = PreparedRows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts = []
                if rows is None:
                    continue
                if matrix.shape[1] != rows.vectors.shape[1]:
                    raise ValueError("vectors differ in dimension")
                floors = part.column(6).to_numpy(zero_copy_only=False).astype(np.float64)
                floors = np.where(np.isnan(floors), NO_SCORE, np.rint(floors * MICRO))
                for at in range(0, len(ids), QUERIES_PER_STEP):
                    step = slice(at, at + QUERIES_PER_STEP)
                    queries = PreparedQueries(QueryBlock(ids[step], matrix[step]))
                    best = BestRows(len(queries.ids), k, threshold, floors[step].astype(np.int64))
                    score_into(best, np.arange(len(queries.ids)), queries, rows)
                    yield best.batch(queries.ids)

    return run


# --- score reports ---------------------------------------------------------------


def search_diagnostics(hits: DataFrame, threshold: float) -> DataFrame:
    """Per query of an unfiltered top-k: hits at the threshold, their least and highest
    score, and the best score of all, also where none reaches the threshold."""
    good = F.when(F.col("score") >= threshold, F.col("score"))
    return hits.groupBy("query_id").agg(
        F.count(good).alias("n_hits"),
        F.min(good).alias("min_score"),
        F.max(good).alias("max_score"),
        F.max("score").alias("best_score"),
    )


def score_stats(hits: DataFrame) -> DataFrame:
    """Candidates per query: count, lowest and highest score."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def best_when_empty(all_hits: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """Queries without a hit at the threshold, and the best score there was.

    ``all_hits`` is a search without threshold (k = 1 is enough); the score is null
    when the corpus is empty.
    """
    best = all_hits.where(F.col("rank") == 1).select(
        "query_id", F.col("score").alias("best_score")
    )
    missed = F.col("best_score").isNull() | (F.col("best_score") < threshold)
    return queries.select("query_id").join(best, "query_id", "left").where(missed)
