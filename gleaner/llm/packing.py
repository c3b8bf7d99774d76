"""Packing documents into training windows by best-fit decreasing.

Each task packs the documents of its own partition, so nothing is shuffled. Overlong
documents are first cut into full windows; the rest of each waits until ``ROUND``
pieces are together (bounded memory). A round is packed longest first, each piece into
the tightest open window that takes it; a segment tree over remaining capacities finds
that window. What best fit leaves badly filled at the end of a round is cut to fill the
larger gaps of the other windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gleaner.llm.tokens import ByteBpe
from gleaner.llm.workers import ready

END_ID = 0
ROUND = 20_000
#: Smaller gaps stay padding rather than taking scraps of documents.
MIN_GAP = 32

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema([(column.split()[0], pa.int64()) for column in SCHEMA.split(", ")])


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that takes a length."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def take(self, length: int) -> int | None:
        """Remove and return a window of the smallest capacity >= length, if any."""
        node = length + self.leaves
        if not self.counts[node]:
            # Up until a right sibling holds windows, then down along its left edge.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        free = node - self.leaves
        self._change(free, -1)
        return self.windows[free].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of indices into ``lengths``; all lengths are 1 to capacity."""
    tree = CapacityTree(capacity)
    windows: list[list[int]] = []
    free: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        w = tree.take(lengths[i])
        if w is None:
            w = len(windows)
            windows.append([])
            free.append(capacity)
        windows[w].append(i)
        free[w] -= lengths[i]
        if free[w]:
            tree.add(free[w], w)
    return windows


def fill_gaps(
    windows: list[list[tuple[int, int, int]]], capacity: int, min_gap: int = MIN_GAP
) -> list[list[tuple[int, int, int]]]:
    """Dissolve the emptiest windows into the gaps of the others.

    A window is a list of (piece, from, to). Windows are dissolved, emptiest first,
    while the gaps of at least ``min_gap`` in the rest can take what they hold.
    """
    used = [sum(b - a for _, a, b in w) for w in windows]
    order = sorted(range(len(windows)), key=used.__getitem__)
    gap = lambda i: capacity - used[i] if capacity - used[i] >= min_gap else 0
    room, load, cut = sum(map(gap, order)), 0, 0
    for i in order:
        if load + used[i] > room - gap(i):
            break
        load, room, cut = load + used[i], room - gap(i), cut + 1
    moving = [piece for i in order[:cut] for piece in windows[i]]
    kept = [windows[i] for i in order[cut:]]
    gaps = [gap(i) for i in order[cut:]]
    at = 0
    for piece, a, b in moving:
        while a < b:
            while not gaps[at]:
                at += 1
            take = min(gaps[at], b - a)
            kept[at].append((piece, a, a + take))
            a, gaps[at] = a + take, gaps[at] - take
    return kept


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def _pack(
    batches: Iterator[pa.RecordBatch], json_path: str, ranks_path: str | None, capacity: int
) -> Iterator[pa.RecordBatch]:
    encoder = ByteBpe(json_path, ranks_path)
    sequence = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def flush() -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], schema=_ARROW
        )
        rows.clear()
        return out

    def pack_round() -> None:
        nonlocal sequence
        lengths = [len(piece[2]) for piece in waiting]
        windows = [
            [(i, 0, lengths[i]) for i in window] for window in best_fit(lengths, capacity)
        ]
        for window in fill_gaps(windows, capacity):
            offset = 0
            for i, a, b in window:
                doc_id, start, ids, total = waiting[i]
                crc = _crc(ids[a:b])
                rows.append((doc_id, start + a, b - a, crc, total, sequence, offset))
                offset += b - a
            sequence += 1
        waiting.clear()

    for batch in batches:
        for doc_id, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
        ):
            ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
            total = len(ids)
            full = total - total % capacity
            for start in range(0, full, capacity):
                piece = ids[start : start + capacity]
                rows.append((doc_id, start, capacity, _crc(piece), total, sequence, 0))
                sequence += 1
            if full < total:
                waiting.append((doc_id, full, ids[full:].copy(), total))
            if len(waiting) >= ROUND:
                pack_round()
            if len(rows) >= ROUND:
                yield flush()
    if waiting:
        pack_round()
    if rows:
        yield flush()


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 1024
) -> DataFrame:
    """Pieces of documents and their place in windows of ``capacity`` tokens.

    A document is its ids followed by ``END_ID``; every id lies in exactly one piece.
    A null or empty text is the end id alone; null ids and repeated rows are documents
    like any other. ``sequence_id`` is unique over all partitions; windows are padded
    from their last piece to the capacity. An empty table gives no pieces. Other columns
    are ignored.
    """
    ready(docs.sparkSession)
    pack = partial(_pack, json_path=json_path, ranks_path=ranks_path, capacity=capacity)
    narrow = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return narrow.mapInArrow(pack, SCHEMA)
