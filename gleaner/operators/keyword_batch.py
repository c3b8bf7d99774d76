"""Keyword search for many queries at once: a join on short strings, then a check.

A query matches where its folded text is a substring of an article's search text. Words
are what single blanks part, so where a query matches, its longest word stands inside a
word of the article. Articles and queries therefore meet on a string of up to ``GRAM``
characters, the head of that word: an article holds each such string once, so a query and
an article meet once at most, and nothing is left to be told apart. A query that is that
string needs no further test; any other is tested as a whole.

An article's strings are cut out where it is scanned, and only those that some query asks
for are kept. Queries below a proven size are broadcast and articles stay where they are;
otherwise strings and queries are shuffled, with the rows of frequent strings spread by a
salt, and only articles' texts and the queries left to test meet once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import fold, strip
from gleaner.operators.bounds import (
    broadcast_if_bounded,
    expand_to_members,
    is_bounded,
    join_hot,
)
from gleaner.operators.listing import ITEM_FIELDS, news_items
from gleaner.operators.paging import Page
from gleaner.session import scratch_path
from gleaner.settings import BROADCAST_LIMIT_BYTES, DEFAULT_PAGE_LIMIT

#: Characters of a query's longest word that articles are joined on; shorter ones are whole.
GRAM = 8
#: Asked strings that are sent to the tasks as they are; of more, one bit each of ``MARKS``.
LISTED = 10_000
MARKS = 1 << 20
#: What a row of a broadcast table costs besides its texts.
ROW_BYTES = 64
#: Ranges of the source order that matches are counted by.
RANGES = 256

MATCH_DDL = "query_id bigint, id bigint, seq bigint"
TOTAL_DDL = "query_id bigint, total bigint, first_seq bigint"


@dataclass
class Asked:
    """Distinct folded texts, who asked them, and how many there are."""

    texts: DataFrame  # rep_id, q, gram
    members: DataFrame  # query_id, rep_id, n
    n_texts: int
    n_queries: int
    text_bytes: int
    gram_sizes: list[int]  # lengths of the grams


def keyword_batch(
    articles: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Every (query, article) match: the same literal substring test for all queries."""
    asked = _ask(queries)
    if not asked.n_texts:
        return articles.sparkSession.createDataFrame([], MATCH_DDL)
    matches = _matches(articles, asked, broadcast_bytes)
    if asked.n_texts == asked.n_queries:
        return matches.withColumnRenamed("rep_id", "query_id")
    return join_hot(
        matches, asked.members, ["rep_id"], "id", asked.n_queries, 24, broadcast_bytes
    ).select("query_id", "id", "seq")


def keyword_totals(
    articles: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """(query_id, total, first_seq) of every query with a match.

    Matches are counted per distinct text before they are given to all who asked it.
    """
    asked = _ask(queries)
    if not asked.n_texts:
        return articles.sparkSession.createDataFrame([], TOTAL_DDL)
    totals = (
        _matches(articles, asked, broadcast_bytes)
        .groupBy("rep_id")
        .agg(F.count("*").alias("total"), F.min("seq").alias("first_seq"))
    )
    return join_hot(
        asked.members, totals, ["rep_id"], "query_id", asked.n_texts, 24, broadcast_bytes
    ).select("query_id", "total", "first_seq")


def keyword_pages(
    articles: DataFrame,
    queries: DataFrame,
    page: int = 1,
    limit: int = DEFAULT_PAGE_LIMIT,
    broadcast_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """The same page of every query's matches in source order, each with its envelope.

    ``query_id, query, total, page, limit, total_pages``, then ``position`` and the item.
    A query with no item on the page (no match, blank, past the end) has one row with a
    null position. Matches are written down once and counted per query and range of the
    source order; the running sum of these counts says which ranges the page falls into, so
    only their matches are shuffled and ranked, and no task meets all matches of a query.
    """
    at = Page.clamp(page, limit)
    asked = _ask(queries)
    named = queries.select("query_id", "query")
    if asked.n_texts:
        found = _pinned(_matches(articles, asked, broadcast_bytes), "matches")
        ranged = _with_range(found)
        items, totals = _page_of_each(articles, ranged, asked, at, broadcast_bytes)
        told = join_hot(
            asked.members, totals, ["rep_id"], "query_id", asked.n_texts, 24, broadcast_bytes
        ).select("query_id", "total")
        envelopes = named.join(told, "query_id", "left")
    else:
        envelopes = named.withColumn("total", F.lit(0).cast("bigint"))
        empty = news_items(articles.where(F.lit(False)))
        items = empty.select(
            F.lit(0).cast("bigint").alias("query_id"), F.lit(0).cast("bigint").alias("position"), "*"
        )
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(at.limit))).cast("bigint")
    return envelopes.select(
        "query_id",
        "query",
        total.alias("total"),
        F.lit(at.page).alias("page"),
        F.lit(at.limit).alias("limit"),
        pages.alias("total_pages"),
    ).join(items, "query_id", "left")


def _pinned(rows: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, in columns, and read back: smaller than a checkpoint."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _with_range(matches: DataFrame) -> DataFrame:
    """Add ``part``, the range of the source order that a match lies in."""
    shares = [nth / RANGES for nth in range(1, RANGES)]
    bounds = matches.agg(F.percentile_approx("seq", shares, 100 * RANGES)).first()[0]
    bounds = sorted(set(bounds or []))
    if not bounds:
        return matches.withColumn("part", F.lit(0))
    # Among every sixteenth bound first, then among the sixteen that follow.
    rows = _passed(F.array(*map(F.lit, bounds[15::16]))) * 16 if bounds[15:] else F.lit(0)
    within = _passed(F.slice(F.array(*map(F.lit, bounds)), rows + 1, F.lit(16)))
    return matches.withColumn("part", rows + within)


def _passed(bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda bound: bound <= F.col("seq")))


def _page_of_each(
    articles: DataFrame, ranged: DataFrame, asked: Asked, at: Page, broadcast_bytes: int
) -> tuple[DataFrame, DataFrame]:
    """Items of the page per query, and the number of matches per distinct text."""
    cells = ranged.groupBy("rep_id", "part").agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("rep_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    # Each range on the page has a row on it, so there are at most ``limit`` per text.
    reached = (
        cells.withColumn("before", before)
        .where((F.col("before") < at.start + at.limit) & (F.col("before") + F.col("n") > at.start))
        .drop("n")
    )
    most = asked.n_texts * at.limit
    reached = broadcast_if_bounded(reached, most, ROW_BYTES, broadcast_bytes)
    within = Window.partitionBy("rep_id", "part").orderBy("seq", "id")
    position = F.col("before") + F.row_number().over(within) - 1 - at.start
    placed = (
        ranged.join(reached, ["rep_id", "part"])
        .withColumn("position", position)
        .where(F.col("position").between(0, at.limit - 1))
        .select("rep_id", "id", "seq", "position")
    )
    placed = broadcast_if_bounded(placed, most, ROW_BYTES, broadcast_bytes)
    found = news_items(articles, "seq").join(placed, ["id", "seq"]).drop("seq")
    items = expand_to_members(found.withColumnRenamed("rep_id", "query_id"), asked.members)
    totals = cells.groupBy("rep_id").agg(F.sum("n").alias("total"))
    return items.select("query_id", "position", *ITEM_FIELDS), totals


# --- queries ---------------------------------------------------------------------


def _longest(words: Column) -> Column:
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]


def _ask(queries: DataFrame) -> Asked:
    members = queries.select("query_id", fold(strip("query")).alias("q")).where("q <> ''")
    distinct = members.groupBy("q").agg(
        F.min("query_id").alias("rep_id"), F.count("*").alias("n")
    )
    # A text of blanks only has the empty gram, which every article holds.
    gram = F.substring(_longest(F.split("q", " ")), 1, GRAM)
    texts = distinct.select("rep_id", "n", "q", gram.alias("gram"))
    told = texts.agg(
        F.count("*"),
        F.sum("n"),
        F.sum(2 * F.octet_length("q") + ROW_BYTES),
        F.collect_set(F.length("gram")),  # at most GRAM + 1 numbers
    ).first()
    key = F.sha2("q", 256).alias("key")
    reps = texts.select(key, "rep_id", "n")
    who = join_hot(members.select("query_id", key), reps, ["key"], "query_id", told[0], 128)
    return Asked(
        texts.drop("n"),
        who.drop("key"),
        told[0],
        told[1] or 0,
        told[2] or 0,
        sorted(told[3]),
    )


# --- matching --------------------------------------------------------------------


def _grams(asked: Asked) -> Column:
    """The distinct strings that some text is looked up by and the article holds.

    Where texts are looked up by very many, some others that share a mark with one.
    """
    words = F.array_distinct(F.split("search_blob", " "))
    held = F.flatten(F.transform(words, lambda word: _cut(word, asked.gram_sizes)))
    if 0 in asked.gram_sizes:
        held = F.concat(held, F.array(F.lit("")))
    grams = asked.texts.select("gram").distinct()
    listed = [row["gram"] for row in grams.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        return F.array_intersect(held, F.split(F.lit(" ".join(listed)), " "))
    marks = [0] * (MARKS // 32)
    for row in grams.select(_mark("gram").alias("at")).distinct().toLocalIterator():
        marks[row["at"] >> 5] |= 1 << (row["at"] & 31)
    bits = F.split(F.lit(" ".join(map(str, marks))), " ").cast("array<bigint>")

    def asked_for(gram: Column) -> Column:
        at = _mark(gram)
        of_its_32 = F.get(bits, F.shiftright(at, 5).cast("int"))
        return F.getbit(of_its_32, F.pmod(at, F.lit(32)).cast("int")) == 1

    return F.filter(F.array_distinct(held), asked_for)


def _mark(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(MARKS))


def _cut(word: Column, sizes: list[int]) -> Column:
    """Every string of one of these lengths in a word."""
    last = F.length(word)
    none = F.array().cast("array<string>")

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(last - size + 1, F.lit(1)))
        cut = F.transform(starts, lambda at: F.substring(word, at, F.lit(size)))
        return F.when(last >= size, cut).otherwise(none)

    return F.concat(none, *[pieces(size) for size in sizes if size])


def _matches(articles: DataFrame, asked: Asked, broadcast_bytes: int) -> DataFrame:
    """(rep_id, id, seq) of every match of a distinct text.

    Articles come once each, as they are prepared.
    """
    articles = articles.select("id", "seq", "search_blob")
    # Where a text is its own gram there is nothing left to test.
    q = F.when(F.col("q") != F.col("gram"), F.col("q")).alias("q")
    texts = asked.texts.select("rep_id", "gram", q)
    holds = F.col("q").isNull() | F.contains("search_blob", "q")
    gram = F.explode(_grams(asked)).alias("gram")
    if is_bounded(1, asked.text_bytes, broadcast_bytes):
        met = articles.select("*", gram).join(F.broadcast(texts), "gram")
        return met.where(holds).select("rep_id", "id", "seq")
    # Read twice; preparing them anew would shuffle their texts once more.
    articles = _pinned(articles, "articles")
    met = join_hot(
        articles.select("id", "seq", gram),
        texts, ["gram"], "id", asked.n_texts, asked.text_bytes, broadcast_bytes,
    ).select("rep_id", "id", "seq", "q")
    # Compared null-safe, no side is filtered, and both uses of ``met`` share its shuffles.
    of = articles.select(F.col("id").alias("of_id"), F.col("seq").alias("of_seq"), "search_blob")
    same = F.col("id").eqNullSafe(F.col("of_id")) & F.col("seq").eqNullSafe(F.col("of_seq"))
    tested = met.where("q IS NOT NULL").join(of, same).where(holds)
    columns = ["rep_id", "id", "seq"]
    return met.where("q IS NULL").select(*columns).unionByName(tested.select(*columns))
