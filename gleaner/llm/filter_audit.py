"""What each of several filters removes under every order of applying them.

A document counts by its mask, the set of filters it fails. Orders are permutations of
the filters by Lehmer rank, so those beginning alike are an interval of ranks: a mask is
removed at step s of all orders whose first s - 1 filters it passes and whose s-th it
fails. Each such interval adds the mask's count at its first rank and takes it off
behind its last; a running sum over the ranks gives what every order removes at every
step. The rest follows from that: kept, redundant, unique failures, Shapley sums.

Documents are read once and become narrow rows; equal texts are found by SHA-256.
Everything behind the masks has a fixed number of rows per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.workers import ready

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Filters by letter, in the order of their bits in a mask.
LETTERS = "ABCDE"

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Rank of the first permutation of ``range(n)`` that begins with ``prefix``."""
    rank = 0
    for at, item in enumerate(prefix):
        smaller = item - sum(earlier < item for earlier in prefix[:at])
        rank += smaller * factorial(n - at - 1)
    return rank


def interval_ends(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where the ranks begin and end that remove a mask at a step."""
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            first = lehmer_rank(prefix, n)
            passed = sum(1 << item for item in prefix[:-1])
            for mask in range(1 << n):
                if mask >> prefix[-1] & 1 and not mask & passed:
                    yield mask, step, first, 1
                    yield mask, step, first + factorial(n - step), -1


def order_totals(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Totals per part, order and step from ``part, mask, n, good, toxic``.

    A part and mask may have several rows. One row, zeros included, per part of
    ``counts``, each of the orders of ``letters`` and each step: ``part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. No
    counts give no rows.
    """
    spark, n = counts.sparkSession, len(letters)
    measures = ("n", "good", "toxic")
    counts = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in measures))
    ends = spark.createDataFrame(
        list(interval_ends(n)), "mask int, step int, rank int, sign int"
    )
    steps = spark.createDataFrame(
        [
            (rank, "".join(letters[i] for i in order), step + 1, 1 << order[step])
            for rank, order in enumerate(permutations(range(n)))
            for step in range(n)
        ],
        "rank int, filter_order string, step int, bit int",
    )
    # Both tables have a fixed size (1,680 and 600 rows for five filters).
    changes = counts.join(F.broadcast(ends), "mask").select(
        "part", "step", "rank", *((F.col(c) * F.col("sign")).alias(c) for c in measures)
    )
    bits = F.array(*(F.lit(1 << i) for i in range(n)))
    per_part = counts.groupBy("part").agg(
        F.sum("n").alias("documents"),
        *(
            F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails {i}")
            for i in range(n)
        ),
        *(
            F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only {i}")
            for i in range(n)
        ),
    )
    at = F.array_position(bits, F.col("bit")).cast("int")
    zeros = per_part.select(
        "part",
        F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"),
        *(F.lit(0).cast("long").alias(c) for c in measures),
    ).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"), *measures
    )
    by_rank = Window.partitionBy("part", "step").orderBy("rank")
    upto_rank = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    by_step = Window.partitionBy("part", "rank").orderBy("step")
    upto_step = by_step.rowsBetween(Window.unboundedPreceding, 0)
    removed = (
        changes.unionByName(zeros)
        .groupBy("part", "step", "rank")
        .agg(*(F.sum(c).alias(c) for c in measures))
        .select("part", "step", "rank", *(F.sum(c).over(upto_rank).alias(c) for c in measures))
        .where(F.col("rank") < factorial(n))
        .withColumn("gone", F.sum("n").over(upto_step))
    )
    of_filter = Window.partitionBy("part", "bit")
    fails, only = (
        F.get(F.array(*(F.col(f"{name} {i}") for i in range(n))), at - 1) for name in ("fails", "only")
    )
    return (
        removed.join(F.broadcast(steps), ["rank", "step"])
        .withColumn("shapley", F.sum("n").over(of_filter))
        .join(per_part, "part")
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("documents") - F.col("gone")).alias("kept"),
            F.col("n").alias("removed"),
            (fails - F.col("n")).alias("redundant"),
            only.alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            "shapley",
        )
    )


def text_failures(text: Column, words: Column) -> list[Column]:
    """Conditions of the filters that look at one text alone, from the lowest bit on."""
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n_words < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n_words * MIN_DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    ]


def masked_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: the failures of every document, rows alike counted.

    The last bit is set where the text equals that of a smaller id. Rows of the smallest
    id itself do not fail; a null id neither fails nor counts as smaller.
    """
    ready(docs.sparkSession)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    split = given.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    failed = text_failures(F.col("text"), F.col("words"))
    mask = sum(
        (F.when(fails, 1 << bit).otherwise(0) for bit, fails in enumerate(failed)), F.lit(0)
    )
    # Checkpointed: narrow rows, wanted twice, made of whole texts.
    rows = (
        split.select(
            "doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
        )
        .groupBy("doc_id", "part", "mask", "digest")
        .agg(F.count("*").alias("n"))
        .checkpoint()
    )
    # The smallest id of a text meets its own row alone, so that a text with very many
    # copies is never gathered.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("first", F.lit(True))
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    last_bit = F.when(repeats, 1 << len(failed)).otherwise(0)
    return rows.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("mask") + last_bit).alias("mask"), "n"
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five filters remove from ``docs`` per language, order and step.

    ``labels`` is (doc_id, quality, toxic): documents with a label 1 are the good and the
    toxic ones; of several rows of an id one with 1 is enough, null labels and ids say
    nothing. Null texts and languages are empty, an empty text fails the first filter
    only (and the last, as any text). Repeated rows count one by one. An empty table gives
    an empty result. Other columns are ignored.
    """
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rows = masked_documents(docs).join(told, "doc_id", "left")
    counted = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *(
            F.sum(F.col("n") * F.coalesce(label, F.lit(0))).alias(label)
            for label in ("good", "toxic")
        ),
    )
    # At most 32 rows per part; everything behind is computed from them several times.
    return order_totals(counted.checkpoint())
