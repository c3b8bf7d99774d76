"""Text to vectors with a pluggable model.

An embedder is any object with ``embed_batch(texts) -> vectors``: one vector per
text, or one list of token vectors per text, which is then mean-pooled. What travels
to the tasks is a factory, called once per task, so a model is loaded where it runs.
An embedder class with ``vector_of(column)`` is a column expression and needs no Python.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import SEPARATORS, TOKEN_PATTERN, empty_to_null, is_blank, strip
from gleaner.functions.vectors import dense_counts, l2_normalize
from gleaner.session import ship_package
from gleaner.settings import ENCODE_BATCH, VECTOR_DIM


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]): ...


class HashingEmbedder:
    """Offline default: word counts hashed into ``dim`` buckets, optionally unit length."""

    def __init__(self, dim: int = VECTOR_DIM, normalize: bool = False) -> None:
        self.dim = dim
        self.normalize = normalize
        self._words = re.compile(TOKEN_PATTERN)
        self._bucket: dict[str, int] = {}

    def _bucket_of(self, word: str) -> int:
        bucket = self._bucket.get(word)
        if bucket is None:
            digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
            bucket = int(digest[:8], 16) % self.dim
            if len(self._bucket) < 200_000:
                self._bucket[word] = bucket
        return bucket

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            buckets = [self._bucket_of(w) for w in self._words.findall(text.lower())]
            row += np.bincount(buckets, minlength=self.dim) if buckets else 0
        if self.normalize:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norms == 0, 1, norms)
        return out

    def vector_of(self, text: Column | str) -> Column:
        """The same as an expression over a text column; null counts as empty."""
        text = F.col(text) if isinstance(text, str) else text
        words = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
        vector = dense_counts(F.transform(F.array_remove(words, ""), self._bucket_column), self.dim)
        return l2_normalize(vector).cast("array<float>") if self.normalize else vector

    def _bucket_column(self, word: Column) -> Column:
        number = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
        return F.pmod(number, F.lit(self.dim)).cast("int")


def native_embedder(factory: Callable[[], Embedder]):
    """The embedder itself where its class (alone or in a ``partial``) is an expression."""
    made = factory.func if isinstance(factory, partial) else factory
    return factory() if hasattr(made, "vector_of") else None


def embedding_text(title: Column, summary: Column) -> Column:
    empty = F.lit("")
    return strip(
        F.concat(F.coalesce(title, empty), F.lit("\n"), F.coalesce(summary, empty))
    )


def payload() -> Column:
    return F.struct(
        F.col("id"),
        empty_to_null("tieu_de").alias("title"),
        empty_to_null("summary").alias("summary"),
        empty_to_null("ngay_dang").alias("publish_date"),
    )


def points_to_embed(articles: DataFrame) -> DataFrame:
    """(id, text, payload): what a build encodes; never the content."""
    text = embedding_text(F.col("tieu_de"), F.col("summary"))
    return articles.select("id", text.alias("text"), payload().alias("payload"))


def embed_column(
    df: DataFrame,
    text: str,
    factory: Callable[[], Embedder],
    dim: int | None = None,
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """Add ``vector``. Only the text column crosses to Python, and only for a model."""
    native = native_embedder(factory)
    if native is not None:
        if dim is not None and native.dim != dim:
            raise ValueError(f"vectors of dimension {native.dim}, expected {dim}")
        return df.withColumn("vector", native.vector_of(text))
    ship_package(df.sparkSession)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, expected = factory(), dim
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            pieces = []
            for start in range(0, len(texts), batch_size):
                piece = encode_texts(model, texts[start : start + batch_size], expected)
                expected = piece.shape[1]
                pieces.append(piece)
            yield to_list_array(pieces)

    # The annotations above are not resolvable in the tasks; state the types here.
    encode.__annotations__ = {
        "batches": Iterator[pa.Array],
        "return": Iterator[pa.Array],
    }
    udf = F.arrow_udf(encode, T.ArrayType(T.FloatType(), containsNull=False))
    return df.withColumn("vector", udf(F.col(text)))


def encode_texts(model: Embedder, texts: list[str], dim: int | None) -> np.ndarray:
    """One checked model call: a vector per text, all of one dimension."""
    raw = model.embed_batch(texts)
    if len(raw) != len(texts):
        raise ValueError(f"{len(raw)} vectors returned for {len(texts)} texts")
    if not isinstance(raw, np.ndarray):
        raw = [np.asarray(item, np.float64) for item in raw]
        raw = [item.mean(axis=0) if item.ndim == 2 else item for item in raw]
        sizes = {item.shape for item in raw}
        if len(sizes) > 1:
            raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
        raw = np.stack(raw)
    elif raw.ndim == 3:
        raw = raw.mean(axis=1)
    if dim is not None and raw.shape[1] != dim:
        raise ValueError(f"vectors of dimension {raw.shape[1]}, expected {dim}")
    return raw.astype(np.float32, copy=False)


def to_list_array(pieces: list[np.ndarray]) -> pa.Array:
    if not pieces:
        return pa.array([], pa.list_(pa.float32()))
    matrix = np.concatenate(pieces)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """(memo_key, rep_id, query, n): each stripped text once, blank ones left out.

    The text kept is the unstripped one of the lowest query id; that is what gets
    embedded. Case and accents stay significant.
    """
    return (
        queries.where(~is_blank("query"))
        .groupBy(strip("query").alias("memo_key"))
        .agg(
            F.min("query_id").alias("rep_id"),
            F.min_by("query", "query_id").alias("query"),
            F.count("*").alias("n"),
        )
    )


def embed_queries(
    queries: DataFrame,
    factory: Callable[[], Embedder],
    prefix: str = "",
    dim: int | None = None,
) -> DataFrame:
    """(query_id, query, vector) of query rows, with an optional instruction prefix."""
    texts = queries.withColumn("text", F.concat(F.lit(prefix), F.col("query")))
    return embed_column(texts, "text", factory, dim).select("query_id", "query", "vector")
