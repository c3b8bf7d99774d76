"""Embed articles into the vector store."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.operators.audit import pending_articles
from gleaner.operators.embed import Embedder, embed_column, points_to_embed
from gleaner.settings import ENCODE_BATCH, SLICE_ROWS, VECTOR_DIM
from gleaner.sources.vector_store import VectorStore

INCREMENTAL, FORCE, RECREATE = "incremental", "force", "recreate"


@dataclass(frozen=True)
class BuildReport:
    encoded: int
    empty_texts: int
    already_stored: int


def build_vectors(
    articles: DataFrame,
    store: VectorStore,
    factory: Callable[[], Embedder],
    mode: str = INCREMENTAL,
    dim: int = VECTOR_DIM,
    slices: int | None = None,
    batch_size: int = ENCODE_BATCH,
    max_rows: int | None = None,
) -> BuildReport:
    """Incremental: only ids the store lacks. Force: all again. Recreate: from empty.

    Each of ``slices`` id slices is committed on its own; as many as ``SLICE_ROWS`` makes
    of the work at hand, where not given. A rerun after a failure picks up what is missing;
    finished slices are not encoded again. ``max_rows`` says that ``articles`` is a delivery
    of at most so many rows.
    """
    if mode not in (INCREMENTAL, FORCE, RECREATE):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == RECREATE:
        store.recreate(dim)
    else:
        store.ensure(dim)

    already = 0 if mode == RECREATE else store.count()
    todo = articles
    if mode == INCREMENTAL and already:
        todo = pending_articles(articles, store.ids(), max_rows)

    todo, pending = _each_id_once(todo)
    if not pending:
        return BuildReport(0, 0, already)
    slices = slices or math.ceil(pending / SLICE_ROWS)

    # Slices of a stored article table are made of its partitions, so each is read once.
    key = "bucket" if "bucket" in articles.columns else "id"
    encoded = empty = 0
    for part in range(slices):
        points = points_to_embed(
            todo if slices == 1 else todo.where(F.pmod(key, F.lit(slices)) == part)
        )
        seen = Observation()
        points = points.observe(seen, F.count_if(F.col("text") == "").alias("empty"))
        vectors = embed_column(points, "text", factory, dim, batch_size).drop("text")
        encoded += store.upsert(vectors, replace=mode == FORCE and already > 0, unique=True)
        empty += seen.get["empty"]
    if mode == FORCE and 2 * encoded >= already > 0:
        store.compact()
    return BuildReport(encoded, empty, already)


def _each_id_once(articles: DataFrame) -> tuple[DataFrame, int]:
    """Of articles whose URLs share an id, the first, and the number of ids; only ids
    are grouped."""
    per_id = articles.groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    ids, shared = per_id.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    if not shared:
        return articles, ids
    twice = per_id.where("n > 1").select("id", "first")
    first = articles.join(twice, "id", "left").where("first IS NULL OR seq = first")
    return first.drop("first"), ids
