"""Joins against a side whose size is known, with a way on when it is too big."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.settings import BROADCAST_LIMIT_BYTES

SALTS = 32
MEMBERS_PER_SALT = 10_000


def is_bounded(max_rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return max_rows * row_bytes <= limit


def broadcast_if_bounded(
    df: DataFrame, max_rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Hint a broadcast only when ``max_rows * row_bytes`` is within the limit."""
    return F.broadcast(df) if is_bounded(max_rows, row_bytes, limit) else df


def anti_join_large(
    small: DataFrame, large: DataFrame, keys: list[str], max_rows: int, row_bytes: int
) -> DataFrame:
    """Rows of ``small`` whose keys are not in a far larger table.

    The large side is first cut down to the small side's keys, so that within the
    bound it is scanned in place instead of shuffled.
    """
    wanted = broadcast_if_bounded(small.select(*keys), max_rows, row_bytes)
    known = large.select(*keys).join(wanted, keys, "left_semi")
    return small.join(known, keys, "left_anti")


def join_hot(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_on: str,
    right_rows: int,
    right_row_bytes: int,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Inner join where one key may hold a third of the left rows.

    A bounded right side is broadcast, so the left side stays where it is. Otherwise
    each key's left rows are spread by a hash of ``spread_on`` over ``SALTS`` sub-keys
    and the right rows are repeated for each.
    """
    if is_bounded(right_rows, right_row_bytes, limit):
        return left.join(F.broadcast(right), keys)
    salt = F.pmod(F.xxhash64(spread_on), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (
        left.withColumn("salt", salt)
        .join(right.withColumn("salt", every), [*keys, "salt"])
        .drop("salt")
    )


def spread_hot(
    rows: DataFrame,
    members: DataFrame,
    keys: list[str],
    spread_on: str,
    max_members: int,
    per_salt: int = MEMBERS_PER_SALT,
) -> tuple[DataFrame, DataFrame]:
    """``rows`` and the ``members`` that want them by ``keys``, each with a ``salt`` to join on.

    A row that very many members want is repeated for sub-keys of about ``per_salt``
    members; all others stand once, wanted or not. So few can be that hot that they are
    broadcast to both sides, and neither is shuffled here.
    """
    salts = F.ceil(F.count("*") / F.lit(per_salt)).cast("int")
    hot = members.groupBy(*keys).agg(salts.alias("salts")).where("salts > 1")
    hot = broadcast_if_bounded(hot, max_members // per_salt, 32)
    salts = F.coalesce("salts", F.lit(1))
    salt = F.pmod(F.xxhash64(spread_on), salts).cast("int")
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    return (
        rows.join(hot, keys, "left").withColumn("salt", every).drop("salts"),
        members.join(hot, keys, "left").withColumn("salt", salt).drop("salts"),
    )


def expand_to_members(results: DataFrame, members: DataFrame) -> DataFrame:
    """Give every member query the results of its representative.

    ``members`` is (query_id, rep_id, n) with n the members of that representative.
    A popular one is split into sub-keys of about ``MEMBERS_PER_SALT`` members, and
    only its results are repeated.
    """
    salts = F.ceil(F.col("n") / F.lit(MEMBERS_PER_SALT)).cast("int")
    sizes = members.select("rep_id", "n").distinct()
    spread = members.withColumn(
        "salt", F.pmod(F.xxhash64("query_id"), salts).cast("int")
    ).drop("n")
    repeated = (
        results.withColumnRenamed("query_id", "rep_id")
        .join(sizes, "rep_id")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("n")
    )
    return spread.join(repeated, ["rep_id", "salt"]).drop("rep_id", "salt")
