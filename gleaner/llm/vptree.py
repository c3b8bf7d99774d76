"""Nearest neighbours by vantage-point trees, one per shard.

The largest inner product becomes the smallest distance once every vector gets one more
coordinate that brings it to the length of the longest. Each shard's tree halves its
vectors by their distance from a vantage point. A query leaves out a half if the triangle
inequality, with the distance of its worst hit so far times ``factor``, says that nothing
nearer lies there. Factor one, the default, makes the search exact; less prunes more and
misses more, how much more depends on the vectors.

A task holds one shard (bounded in bytes), builds its tree once and lets the queries
stream past it. Shards are made of vectors of like magnitude, so that a very long vector
takes no precision from short ones; each shard scales its own, by a power of two.
"""

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.workers import ready

LEAF = 512
SHARD_BYTES = 32 << 20
MIN_SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Queries of which a leaf's scores are held at once.
SCANNED = 256
#: More than the relative error of a product or a squared distance.
ROUNDING = 1e-12
#: Powers of two of the largest component that one shard spans.
BAND = 32


class VpTree:
    """A tree over the rows of ``points``, all of one length."""

    def __init__(self, points: np.ndarray, seed: int = 7) -> None:
        self.points = points
        self.lengths = np.linalg.norm(points, axis=1)
        random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)), random)

    def _build(self, rows: np.ndarray, random: np.random.Generator) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(rows) > LEAF:
            vantage = self.points[rows[random.integers(len(rows))]]
            away = np.linalg.norm(self.points[rows] - vantage, axis=1)
            radius = float(np.median(away))
            near = away <= radius
            if near.all():  # most vectors are equal or equally far
                near = away < radius
            if near.any():
                halves = self._build(rows[near], random), self._build(rows[~near], random)
                inner, outer = float(away[near].max()), float(away[~near].min())
                self.nodes[number] = (vantage, inner, outer, *halves)
                return number
        self.nodes[number] = (rows,)
        return number

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """(scores, rows) of the k best per query, best first; ``own`` ids are left out.

        The last coordinate of ``queries`` is zero, so the product of a query and a point
        is the product of the given vectors. Rows stand in the order of their ids, which
        settles ties; unused places have the row -1.
        """
        self.queries, self.own, self.ids, self.k, self.factor = queries, own, ids, k, factor
        self.scores = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1, dtype=np.int64)
        self.query_lengths = np.linalg.norm(queries, axis=1)
        self.squares = self.query_lengths**2 + self.lengths.max(initial=0.0) ** 2
        self._visit(self.root, np.arange(len(queries)))
        return self.scores, self.rows

    def _worst(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th hit so far, and a little more than the rounding errors."""
        squares = self.squares[active]
        return np.sqrt(np.maximum(squares - 2 * self.scores[active, -1], 0.0) + ROUNDING * squares)

    def _visit(self, number: int, active: np.ndarray) -> None:
        if not len(active):
            return
        node = self.nodes[number]
        if len(node) == 1:
            self._scan(node[0], active)
            return
        vantage, inner, outer, near, far = node
        away = np.linalg.norm(self.queries[active] - vantage, axis=1)
        close = 2 * away <= inner + outer
        for first, second, side, gap in (
            (near, far, close, outer - away),
            (far, near, ~close, away - inner),
        ):
            some, gaps = active[side], gap[side]
            self._visit(first, some)
            self._visit(second, some[gaps <= self.factor * self._worst(some)])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        # The product tells which pairs can enter; only they get their score, summed in one
        # order, so that equal vectors tie.
        found = self.queries[active] @ self.points[rows].T
        found += np.outer(ROUNDING * self.query_lengths[active], self.lengths[rows])
        near = found >= self.scores[active, -1:]
        near &= self.own[active][:, None] != self.ids[rows][None, :]
        some = np.flatnonzero(near.any(axis=1))
        for start in range(0, len(some), SCANNED):
            self._merge(rows, active, near, some[start : start + SCANNED])

    def _merge(self, rows: np.ndarray, active: np.ndarray, near: np.ndarray, some: np.ndarray) -> None:
        nth, place = np.nonzero(near[some])
        scores = np.full((len(some), len(rows)), -np.inf)
        scores[nth, place] = np.einsum(
            "ij,ij->i", self.queries[active[some[nth]]], self.points[rows[place]]
        )
        chosen = active[some]
        scores = np.concatenate([self.scores[chosen], scores], axis=1)
        which = np.concatenate(
            [self.rows[chosen], np.broadcast_to(rows, (len(some), len(rows)))], axis=1
        )
        order = np.lexsort((which, -scores), axis=1)[:, : self.k]
        self.scores[chosen] = np.take_along_axis(scores, order, 1)
        which = np.take_along_axis(which, order, 1)
        self.rows[chosen] = np.where(np.isneginf(self.scores[chosen]), -1, which)


_HITS = "query_id bigint, vec_id bigint, score double"
_HITS_ARROW = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, dtype=np.float64).reshape(len(column), -1)


def _power_of_two(largest: np.ndarray) -> np.ndarray:
    """The power of two that brings a number to between one half and one."""
    return -np.frexp(largest)[1]


class Shard:
    """The vectors of one shard and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # Scaled, squares neither overflow nor vanish; a power of two rounds nothing, so
        # scores stand in the order of the originals.
        scaled = np.ldexp(self.vectors, _power_of_two(np.abs(self.vectors).max()))
        squares = np.einsum("ij,ij->i", scaled, scaled)
        missing = np.maximum(squares.max() - squares, 0.0)
        self.tree = VpTree(np.column_stack([scaled, np.sqrt(missing)]))

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float
    ) -> pa.RecordBatch:
        scaled = np.ldexp(queries, _power_of_two(np.abs(queries).max(axis=1, keepdims=True)))
        wide = np.column_stack([scaled, np.zeros(len(scaled))])
        _, rows = self.tree.search(wide, query_ids, self.ids, k, factor)
        query, place = np.nonzero(rows >= 0)
        row = rows[query, place]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.einsum("ij,ij->i", queries[query], self.vectors[row])
        columns = [query_ids[query], self.ids[row], scores]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _HITS_ARROW, strict=True)], schema=_HITS_ARROW
        )


_KEY = ("width", "band", "shard")


def _search(
    batches: Iterator[pa.RecordBatch], k: int, factor: float
) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, the vectors of a shard before its queries."""
    held_key, parts, shard = None, [], None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in (*_KEY, "asked")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            part = batch.slice(int(a), int(b - a))
            key = tuple(keys[a][:-1])
            if key != held_key:
                held_key, parts, shard = key, [], None
            ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
            if not keys[a][-1]:
                parts.append((ids, vectors))
                continue
            if parts:
                shard = Shard(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts = []
            if shard is not None:
                for at in range(0, len(ids), QUERY_BLOCK):
                    block = slice(at, at + QUERY_BLOCK)
                    yield shard.search(ids[block], vectors[block], k, factor)


def _is_usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, factor: float | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query row.

    ``vectors`` has vec_id and vector (array of numbers); ``queries`` is the condition that
    makes a row a query. ``factor`` is one, which is exact, if not given.
    Nearness is the largest inner product, in double precision; ties
    go to the smaller id. A query's own id is no candidate.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do
    rows without an id. Queries are compared with vectors of their own number of
    components. Repeated rows are candidates of their own; a repeated query is asked once.
    An empty table gives an empty result. Other columns are ignored.
    """
    ready(vectors.sparkSession)
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("vector").cast("array<double>").alias("vector"),
        queries.alias("asked"),
    ).where(F.col("vec_id").isNotNull() & _is_usable(F.col("vector")))
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    usable = usable.withColumn("band", F.floor(F.log2(top) / BAND).cast("int"))
    # At most 66 bands: a double has some 2,100 powers of two.
    figures = usable.agg(
        F.count("*"), F.count_if("asked"), F.collect_set("band"), F.max(F.size("vector"))
    ).first()
    n, n_asked, bands, width = figures
    if not n_asked:
        return usable.select(
            F.col("vec_id").alias("query_id"),
            F.lit(0).alias("rank"),
            "vec_id",
            F.lit(0.0).alias("score"),
        ).limit(0)
    largest = max(SHARD_BYTES // (8 * width), MIN_SHARD_ROWS)
    spread = min(4 * vectors.sparkSession.sparkContext.defaultParallelism, n // MIN_SHARD_ROWS)
    shards = max(math.ceil(n / largest), spread, 1)
    columns = [F.size("vector").alias("width"), "vec_id", "vector"]
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    candidates = usable.select(*columns, "band", dealt, F.lit(0).alias("asked"))
    asked = (
        usable.where("asked")
        .dropDuplicates(["vec_id"])
        .select(*columns, F.explode(F.array(*map(F.lit, sorted(bands)))).alias("band"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        .withColumn("asked", F.lit(1))
    )
    together = candidates.unionByName(asked).repartition(shards * len(bands), *_KEY)
    ordered = together.sortWithinPartitions(*_KEY, "asked")
    hits = ordered.mapInArrow(partial(_search, k=k, factor=1.0 if factor is None else factor), _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
