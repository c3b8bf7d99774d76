"""Dense vector columns (array of float) with higher-order functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.settings import SCORE_DECIMALS


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_double(a), _double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def squared_norm(vector: Column) -> Column:
    return F.aggregate(
        _double(vector), F.lit(0.0), lambda total, x: total + x * x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine rounded once to the working precision; a zero vector scores 0."""
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(
        F.round(dot(a, b) / scale, SCORE_DECIMALS)
    )


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dense_counts(places: Column, dim: int) -> Column:
    """How often each of 0 to ``dim - 1`` stands in an array, as floats.

    The sorted places are cut into runs, and each run is written as the zeros before it
    and its length: linear in the array and the dimension but for the sort.
    """
    zeros = partial(F.array_repeat, F.lit(0.0).cast("float"))

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(
            F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i) != F.get(s, i - 1))
        )

        def of_ends(e: Column) -> Column:
            def run(end: Column, nth: Column) -> Column:
                start = F.when(nth == 0, F.lit(0)).otherwise(F.get(e, nth - 1))
                before = F.when(nth == 0, F.lit(-1)).otherwise(F.get(s, start - 1))
                gap = F.get(s, end - 1) - before - 1
                return F.concat(zeros(gap), F.array((end - start).cast("float")))

            rest = zeros(F.lit(dim - 1) - F.get(s, n - 1))
            return F.flatten(F.concat(F.transform(e, run), F.array(rest)))

        return F.when(n == 0, zeros(F.lit(dim))).otherwise(_bind(ends, of_ends))

    return _bind(F.array_sort(places), of_sorted)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(squared_norm(vector))
    return F.when(norm == 0, _double(vector)).otherwise(
        F.transform(_double(vector), lambda x: x / norm)
    )


def mean_pool(token_vectors: Column) -> Column:
    """Mean over the token axis of an array of token vectors."""
    matrix = token_vectors.cast("array<array<double>>")
    zeros = F.transform(F.get(matrix, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(
        matrix, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y)
    )
    return F.transform(total, lambda x: x / F.size(token_vectors))
