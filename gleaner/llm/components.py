"""Connected components of links, by alternating large and small stars.

Each round replaces the links by links to the smallest neighbour; nothing but two
aggregates per round reaches the driver. The minimum over a node with very many links is
taken before the shuffle; the join that follows streams its links past that one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a")
        .where("b > a AND b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` lead from the larger node a to the smaller b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.unionByName(least.withColumnRenamed("m", "b"))


def _signature(links: DataFrame) -> tuple:
    code = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(code)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); root is the smallest node.

    Links may repeat, run either way or join a node to itself; nodes are not null.
    No links give no rows.
    """
    checkpoint_dir(links.sparkSession)
    current = (
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    before = None
    now = _signature(current)
    while now != before and now[0]:
        current = _small_star(_large_star(current).distinct()).distinct().checkpoint()
        before, now = now, _signature(current)
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
