"""Benchmark decontamination: BM25 over test items, block-max WAND, then verification.

The items are the index, every passage of every document is a query. Passages are windows
of ``2 * PART`` words at steps of ``PART``; items are indexed in parts of ``PART`` words, so
a leaked part lies whole in some passage. The score of a part is divided by the least
score it can have when ``MIN_OVERLAP`` of its shingles are in the passage, so one is the
threshold for all and no such part is missed. For a batch of passages the block maxima
are summed for all blocks at once; WAND runs on passages and blocks that can reach one.
A retrieved item counts as leaked if enough five-word shingles of its question and of its
answer stand around the passage.

The index is built from bounded slices of the benchmark (``SLICE_BYTES`` of text each);
more items mean more passes. Documents are not shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from gleaner.llm.workers import ready


PART = 64
SHINGLE = 5
MIN_OVERLAP = 0.8
K1, B = 1.2, 0.75
MAX_BLOCKS = 32
BLOCK_ITEMS = 8
SLICE_BYTES = 16 << 20
_CACHE_LIMIT = 300_000
MARK = "holds an item"
#: One, less what rounding takes off a score, and off a bound of single-precision maxima.
ENOUGH, SURE = 1 - 1e-9, 1 - 1e-4
_BATCH_WORDS = 40_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def word_of(token: str) -> str:
    return _EDGES.sub("", token.lower())


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around them; bare marks are no words."""
    return [w for w in map(word_of, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last line or sentence is the answer; a single sentence is cut in the middle."""
    body = text.strip()
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n", body)]
    if cuts:
        question, answer = words_of(body[: cuts[-1]]), words_of(body[cuts[-1] :])
        if question and answer:
            return question, answer
    words = words_of(body)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def shingles_of(words: list, size: int = SHINGLE) -> set[tuple]:
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class ItemIndex:
    """Parts of items with scaled BM25 impacts; part numbers are the postings."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items: list[tuple[int | None, list[str], list[str]]] = []
        self.item_of: list[int] = []
        parts: list[list[str]] = []
        for item_id, text in items:
            question, answer = question_and_answer(text)
            words = question + answer
            if not words:
                continue
            for at in range(0, len(words), PART):
                parts.append(words[at : at + PART])
                self.item_of.append(len(self.items))
            self.items.append((item_id, question, answer))
        found_in = Counter(w for p in parts for w in set(p))
        self.ids = {w: i for i, w in enumerate(sorted(found_in))}
        mean = sum(map(len, parts)) / max(len(parts), 1)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.ids]
        for number, part in enumerate(parts):
            tf = Counter(part)
            weight = {}
            for w, n in tf.items():
                idf = np.log(1 + (len(parts) - found_in[w] + 0.5) / (found_in[w] + 0.5))
                weight[w] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(part) / mean))
            lost = int((1 - MIN_OVERLAP) * max(len(part) - SHINGLE + 1, 1)) + 1
            least = sum(sorted(weight.values())[: max(len(weight) - lost, 1)])
            for w, x in weight.items():
                postings[self.ids[w]].append((number, x / least))
        self.impacts = [[x for _, x in ps] for ps in postings]
        self.numbers = [[p for p, _ in ps] for ps in postings]
        # The widest blocks decide which passages are looked at, the narrow ones inside WAND.
        self.wide = max(BLOCK_ITEMS, -(-len(parts) // MAX_BLOCKS))
        self.blocks = -(-len(parts) // self.wide)
        self.block_max = np.zeros((len(self.ids) + 1, max(self.blocks, 1)), dtype=np.float32)
        self.narrow_max: list[dict[int, float]] = []
        for term, ps in enumerate(postings):
            narrow: dict[int, float] = {}
            for number, x in ps:
                block = number // self.wide
                self.block_max[term, block] = max(self.block_max[term, block], x)
                narrow[number // BLOCK_ITEMS] = max(narrow.get(number // BLOCK_ITEMS, 0.0), x)
            self.narrow_max.append(narrow)
        self.cache: dict[str, int] = {}

    def term_of(self, token: str) -> int:
        """Index of the token's word; one past the last for others, -1 for no word."""
        word = word_of(token)
        found = self.ids.get(word, len(self.ids)) if word else -1
        if len(self.cache) >= _CACHE_LIMIT:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = found
        return found

    def search(self, terms: list[int], first: int, last: int) -> dict[int, float]:
        """Parts from ``first`` to before ``last`` with a score of one, up to rounding."""
        cursors = []  # [part, place, term, highest impact]
        for t in terms:
            place = bisect_left(self.numbers[t], first)
            if place < len(self.numbers[t]) and self.numbers[t][place] < last:
                top = self.block_max[t, self.numbers[t][place] // self.wide :].max()
                cursors.append([self.numbers[t][place], place, t, float(top)])
        hits: dict[int, float] = {}
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= SURE:
                    pivot = i
                    break
            if pivot < 0:
                break
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            block = part // BLOCK_ITEMS
            can = sum(self.narrow_max[c[2]].get(block, 0.0) for c in cursors[: pivot + 1])
            if can < SURE:
                # No part of this block before the next cursor's can do.
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, part + 1)
                moving = cursors[: pivot + 1]
            elif cursors[0][0] == part:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= ENOUGH:
                    hits[part] = score
                to, moving = part + 1, cursors[: pivot + 1]
            else:
                to, moving = part, [c for c in cursors[: pivot + 1] if c[0] < part]
            for c in moving:
                numbers = self.numbers[c[2]]
                c[1] = bisect_left(numbers, to, c[1])
                c[0] = numbers[c[1]] if c[1] < len(numbers) else last
            cursors = [c for c in cursors if c[0] < last]
        return hits

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
        """Passages of one document, their index terms, and blocks that may reach one."""
        sums = np.zeros((len(terms) + 1, self.blocks), dtype=np.float64)
        np.cumsum(self.block_max[terms], axis=0, out=sums[1:], dtype=np.float64)
        starts = np.arange(0, max(len(terms) - PART, 1), PART)
        ends = np.minimum(starts + 2 * PART, len(terms))
        # Repeated words count each time here, which only raises the bound.
        reach = (sums[ends] - sums[starts] >= SURE).any(axis=1)
        for passage in np.flatnonzero(reach).tolist():
            inside = np.unique(terms[starts[passage] : ends[passage]])
            inside = inside[inside < len(self.ids)]
            bound = self.block_max[inside].sum(axis=0, dtype=np.float64)
            blocks = np.flatnonzero(bound >= SURE).tolist()
            if blocks:
                yield passage, inside.tolist(), blocks

    def leaks(self, text: str) -> dict[int, tuple[float, float, float, int]]:
        """Leaked items: (score, question overlap, answer overlap, first word)."""
        cache, tokens = self.cache, text.split()
        terms = np.fromiter(
            (self.term_of(t) if (i := cache.get(t)) is None else i for t in tokens),
            dtype=np.int64,
            count=len(tokens),
        )
        real = np.flatnonzero(terms >= 0)
        terms = terms[real]
        found: dict[int, tuple[float, float, float, int]] = {}
        for begin in range(0, len(terms), _BATCH_WORDS):
            # Batches share a passage, so that none is cut.
            batch = terms[begin : begin + _BATCH_WORDS + 2 * PART]
            for passage, inside, blocks in self.candidates(batch):
                at = begin + passage * PART
                hits: dict[int, float] = {}
                for block in blocks:
                    first = block * self.wide
                    hits |= self.search(inside, first, first + self.wide)
                for part, score in hits.items():
                    item = self.item_of[part]
                    if item in found and found[item][0] >= score:
                        continue
                    overlaps = self._overlaps(item, tokens, real, at)
                    if min(overlaps) >= MIN_OVERLAP:
                        found[item] = (score, *overlaps, at)
        return found

    def _overlaps(self, item: int, tokens: list[str], real: np.ndarray, at: int):
        _, question, answer = self.items[item]
        reach = len(question) + len(answer)
        near = real[max(at - reach, 0) : at + 2 * PART + reach]
        words = [word_of(tokens[i]) for i in near]
        shares = []
        for side in (question, answer):
            wanted = shingles_of(side)
            size = min(SHINGLE, len(side))
            shares.append(
                len(wanted & shingles_of(words, size)) / len(wanted)
                if wanted and len(words) >= size
                else float(not wanted)
            )
        return tuple(shares)


def _find(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for item, figures in sorted(index.leaks(text).items()):
                rows.append((doc_id, index.items[item][0], *figures))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _LEAKS_ARROW]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _LEAKS_ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_LEAKS_ARROW)


_LEAKS = (
    "doc_id bigint, item_id bigint, score double, question_overlap double, "
    "answer_overlap double, first_word bigint"
)
_LEAKS_ARROW = pa.schema(
    [
        (n, pa.float64() if kind == "double" else pa.int64())
        for n, kind in (column.split() for column in _LEAKS.split(", "))
    ]
)


def _mark(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaked = [bool(index.leaks(text)) for text in batch.columns[-1].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(leaked, pa.bool_())],
            names=[*batch.schema.names[:-1], MARK],
        )


def item_slices(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes over slices of the benchmark, each of about ``SLICE_BYTES`` of text."""
    items = benchmark.where("text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    for n in range(slices):
        mine = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == n
        rows = items.where(mine).orderBy("item_id", "text").collect()
        yield ItemIndex([(r.item_id, r.text) for r in rows])


def _text() -> object:
    return F.coalesce(F.col("text"), F.lit(""))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item that it holds.

    ``score`` is the best BM25 score of a passage, scaled so that one is the threshold;
    ``first_word`` is where that passage begins. Null and empty texts hold nothing; items
    without words are never found. Repeated documents and items give repeated rows. Other
    columns are ignored.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    found = None
    for index in item_slices(benchmark):
        part = rows.mapInArrow(partial(_find, index=index), _LEAKS)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that hold no item of the benchmark."""
    ready(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(MARK, T.BooleanType())])
    for index in item_slices(benchmark):
        marked = docs.select("*", _text().alias("text to search")).mapInArrow(
            partial(_mark, index=index), schema
        )
        docs = marked.where(~F.col(MARK)).drop(MARK)
    return docs
