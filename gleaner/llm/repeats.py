"""Removal of repeated byte strings with suffix sorting, over all documents.

Every window of ``min_bytes`` bytes has an anchor, the least hashed ``GRAM``-byte string in
it. Equal windows have equal anchors at equal places, so the windows of one anchor
string are all that must be compared with each other. Neighbouring windows mostly
share an anchor; together they are a stretch, known by the hash of its bytes.

1. Stretches become narrow rows (anchor hash, stretch hash, text key, place). Anchors
   found once are done. Where all stretches of an anchor are equal, or a stretch is found
   twice, all its windows are repeated.
2. For the other anchors, one copy of each different stretch is fetched from its text
   and gathered by anchor. A task sorts their suffixes (``suffixes``): windows are taken in
   nodes of 64 neighbours; suffixes that differ within the bytes shared by all windows
   of a node end there, nodes that agree as a whole are repeated, others are halved.
3. An anchor with more bytes of stretches than fit a task is dealt again by longer
   strings, down to single windows.

Texts are known by two 64-bit hashes; copies of a text share their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.suffixes import BASES, SuffixSorter, powers, prefix_sums
from gleaner.llm.workers import ready
from gleaner.session import scratch_path

GRAM = 32
CHUNK = 1 << 19
NODE = 64
#: Bytes of stretches that a task holds; a single anchor with more is dealt again.
TASK_BYTES = 2 << 20
FINER = (16, 1)
_PLACE_BITS = 20


def stretches(data: bytes, min_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(first window, windows, anchor place in the first window) of a text."""
    grams = min_bytes - GRAM + 1
    for at in range(0, max(len(data) - min_bytes + 1, 0), CHUNK):
        part = np.frombuffer(data[at : at + CHUNK + min_bytes - 1], dtype=np.uint8)
        ups, downs = powers(BASES[0], CHUNK + min_bytes)
        sums = prefix_sums(part, downs)
        n = len(part) - GRAM + 1
        code = (sums[GRAM:] - sums[:n]) * ups[:n]
        code ^= code >> np.uint64(33)
        code *= np.uint64(0xFF51AFD7ED558CCD)
        # The place in the low bits makes the leftmost of equal hashes the least.
        code = (code >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)
        code |= np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // grams) * grams, np.iinfo(np.uint64).max)
        padded[:n] = code
        blocks = padded.reshape(-1, grams)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - grams + 1
        least = np.minimum(behind[:windows], ahead[grams - 1 : grams - 1 + windows])
        anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        counts = np.diff(np.append(first, windows))
        for s, k, p in zip(first.tolist(), counts.tolist(), anchor[first].tolist(), strict=True):
            yield at + s, k, p - s


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_LONGS = ("gram", "ctx", "t1", "t2", "place", "windows", "anchor")
_STRETCH = ", ".join(f"{n} bigint" for n in _LONGS)
_STRETCH_ARROW = pa.schema([(n, pa.int64()) for n in _LONGS])


def _stretch_rows(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t1, t2, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for s, k, p in stretches(data, min_bytes):
                gram = xxhash.xxh64_intdigest(data[s + p : s + p + GRAM])
                ctx = xxhash.xxh64_intdigest(data[s : s + k - 1 + min_bytes], seed=p)
                rows.append((_signed(gram), _signed(ctx), t1, t2, s, k, p))
            if len(rows) > 50_000:
                yield _longs(rows, _STRETCH_ARROW)
                rows = []
        yield _longs(rows, _STRETCH_ARROW)


def _longs(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(schema)).T
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c)) for c in columns], schema=schema
    )


_PIECE = (
    "key bigint, copies bigint, t1 bigint, t2 bigint, place bigint, windows bigint, "
    "anchor bigint, bytes binary"
)
_PIECE_ARROW = pa.schema(
    [(n.split()[0], pa.int64()) for n in _PIECE.split(", ")[:-1]] + [("bytes", pa.binary())]
)


def _pieces(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Stretches cut from texts; ``wanted`` lists (gram, copies, place, windows, anchor)."""
    for batch in batches:
        rows, held = [], 0
        for t1, t2, data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w in wanted:
                s, k = w["place"], w["windows"]
                piece = data[s : s + k - 1 + min_bytes]
                rows.append((w["gram"], w["copies"], t1, t2, s, k, w["anchor"], piece))
                held += len(piece)
            if held > TASK_BYTES:
                yield _piece_batch(rows)
                rows, held = [], 0
        yield _piece_batch(rows)


def _piece_batch(rows: list[tuple], schema: pa.Schema = _PIECE_ARROW) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def repeated_windows(rows: list[tuple], min_bytes: int) -> list[tuple[int, int, int, int]]:
    """(t1, t2, from, to) of bytes in repeated windows; rows as in ``_PIECE``."""
    for base in BASES:
        found = _repeated(rows, min_bytes, base)
        if found is not None:
            return found
    raise RuntimeError("three hash functions in a row took unequal strings for equal")


def _repeated(rows: list[tuple], min_bytes: int, base: int):
    key, copies, t1, t2, place, windows, anchor = (
        np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:7]
    )
    sizes = np.array([len(r[7]) for r in rows], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + anchor  # anchors in the buffer
    sorter = SuffixSorter(np.frombuffer(b"".join(r[7] for r in rows), dtype=np.uint8), base)
    last, first = anchor, anchor - windows + 1  # offsets of the anchor in the windows
    group = np.unique(key, return_inverse=True)[1]

    node = np.arange(0, min_bytes, NODE)
    touches = (node[None, :] <= last[:, None]) & (node[None, :] + NODE - 1 >= first[:, None])
    row, which = np.nonzero(touches)
    low, done = node[which], copies[row] > 1
    found: list[np.ndarray] = []

    def classes(member: np.ndarray, start: np.ndarray, length: int):
        """Members in order, a class number each; None if hashes failed."""
        order, shared = sorter.sort(group[row[member]] * 512 + low[member], start, length)
        joined = np.flatnonzero(shared >= length)
        if not sorter.equal_bytes(start[order[joined - 1]], start[order[joined]], length):
            return None
        return order, np.cumsum(shared < length) - 1

    width = NODE
    while len(row):
        place_in_order = np.lexsort((low, group[row]))
        row, low, done = row[place_in_order], low[place_in_order], done[place_in_order]
        every = np.arange(len(row))
        sorted_ = classes(every, at[row] - low, min_bytes - width + 1)
        if sorted_ is None:
            return None
        order, number = sorted_
        members = np.bincount(number)
        open_ = np.bincount(number, ~done[order])
        go_on = (members[number] > 1) & (open_[number] > 0)
        row, low, done = (x[order[go_on]] for x in (row, low, done))
        if width == 1:
            found.append(np.stack([row[~done], low[~done], low[~done]]))
            break
        place_in_order = np.lexsort((low, group[row]))
        row, low, done = row[place_in_order], low[place_in_order], done[place_in_order]
        whole = np.flatnonzero((low >= first[row]) & (low + width - 1 <= last[row]))
        sorted_ = classes(whole, at[row[whole]] - low[whole] - width + 1, min_bytes + width - 1)
        if sorted_ is None:
            return None
        order, number = sorted_
        repeated = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        hit = whole[order[repeated]]
        new = hit[~done[hit]]
        found.append(np.stack([row[new], low[new], low[new] + width - 1]))
        done[hit] = True
        # Equal members stand for one another from here on.
        keep = np.ones(len(row), dtype=bool)
        again = np.concatenate([[False], number[1:] == number[:-1]]) if len(number) else repeated
        keep[whole[order[again]]] = False
        row, low, done = row[keep], low[keep], done[keep]
        width //= 2
        row, low, done = (np.concatenate([x, x]) for x in (row, low, done))
        low[len(low) // 2 :] += width
        inside = (low <= last[row]) & (low + width - 1 >= first[row])
        row, low, done = row[inside], low[inside], done[inside]
    r, a, b = np.concatenate(found, axis=1)
    anchor_at = place[r] + anchor[r]
    start = anchor_at - np.minimum(b, last[r])
    end = anchor_at - np.maximum(a, first[r]) + min_bytes
    order = np.lexsort((start, r))
    r, start, end = r[order], start[order], end[order]
    head = np.ones(len(r), dtype=bool)
    head[1:] = (r[1:] != r[:-1]) | (start[1:] > end[:-1])
    firsts = np.flatnonzero(head)
    ends = end[np.append(firsts[1:], len(r)) - 1] if len(r) else end
    r = r[firsts]
    return list(zip(*(x.tolist() for x in (t1[r], t2[r], start[firsts], ends)), strict=True))


_FOUND_ARROW = pa.schema(
    [pa.field(f.name, f.type) for f in _PIECE_ARROW] + [("start", pa.int64()), ("end", pa.int64())]
)
_FOUND = _PIECE + ", start bigint, end bigint"


def _finer(r: tuple, width: int, min_bytes: int) -> Iterator[tuple]:
    """The windows of a stretch in nodes of ``width``, keyed by what a node shares."""
    key, copies, t1, t2, place, windows, anchor, data = r
    for low in range((anchor - windows + 1) // width * width, anchor + 1, width):
        a, b = max(low, anchor - windows + 1), min(low + width - 1, anchor)
        core = data[anchor - low : anchor - low - width + 1 + min_bytes]
        code = xxhash.xxh64_intdigest(core, seed=xxhash.xxh64_intdigest(f"{key} {low}"))
        piece = data[anchor - b : anchor - a + min_bytes]
        yield (_signed(code), copies, t1, t2, place + anchor - b, b - a + 1, b, piece)


def _sorted_pieces(
    batches: Iterator[pa.RecordBatch], min_bytes: int, finer: int | None
) -> Iterator[pa.RecordBatch]:
    """Repeated bytes of each key; keys above ``TASK_BYTES`` are handed on in finer nodes.

    Where there is nothing finer, members of a key are equal windows.
    """
    held: list[tuple] = []
    held_bytes = 0
    hot = None

    def results(found: list[tuple]) -> pa.RecordBatch:
        blank = (None,) * 8
        rows = [(*blank[:2], t1, t2, *blank[4:], a, b) for t1, t2, a, b in found]
        return _piece_batch(rows, _FOUND_ARROW)

    def handed_on(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if finer is None:
            yield results([(r[2], r[3], r[4], r[4] + min_bytes) for r in rows if r[1] == 1])
            return
        for i in range(0, len(rows), 256):
            parts = [(*f, None, None) for r in rows[i : i + 256] for f in _finer(r, finer, min_bytes)]
            yield _piece_batch(parts, _FOUND_ARROW)

    for part in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
        rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
        if hot is not None:
            same = [r for r in rows if r[0] == hot]
            yield from handed_on(same)
            rows = rows[len(same) :]
            if not rows:
                continue
            hot = None
        held += rows
        held_bytes += sum(len(r[7]) for r in rows)
        if held_bytes <= TASK_BYTES:
            continue
        last = held[-1][0]
        tail = [r for r in held if r[0] == last]
        ready = held[: len(held) - len(tail)]
        if ready:
            yield results(repeated_windows(ready, min_bytes))
        held, held_bytes = tail, sum(len(r[7]) for r in tail)
        if held_bytes > TASK_BYTES:
            yield from handed_on(held)
            held, held_bytes, hot = [], 0, last
    if held:
        yield results(repeated_windows(held, min_bytes))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        text.alias("bytes"),
        *columns,
    )


def repeated_spans(docs: DataFrame, min_bytes: int = 400) -> DataFrame:
    """``t1, t2, spans`` of every text with repeated bytes; spans may touch or overlap.

    ``t1, t2`` are the hashes of the text. A string that starts at two places of
    any texts, or of one, is repeated; two rows with the same text count as two texts.
    """
    spark = docs.sparkSession
    ready(spark)
    path = scratch_path(spark, "stretches")
    long_ones = docs.where(F.octet_length("text") >= min_bytes)
    keyed = _keyed(long_ones)
    keyed.mapInArrow(partial(_stretch_rows, min_bytes=min_bytes), _STRETCH).write.parquet(path)
    rows = spark.read.parquet(path)

    found_again = (
        rows.groupBy("gram")
        .agg(F.count("*").alias("n"), (F.min("ctx") == F.max("ctx")).alias("alike"))
        .where("n > 1")
        .select("gram", "alike")
        .checkpoint()  # with an exchange on both sides the join can split a hot anchor
    )
    again = rows.join(found_again, "gram").checkpoint()
    span = [F.col("place").alias("start"), (F.col("place") + F.col("windows") - 1 + min_bytes).alias("end")]
    alike = again.where("alike").select("t1", "t2", *span)

    mixed = again.where("NOT alike").drop("alike")
    kinds = mixed.groupBy("gram", "ctx").agg(
        F.count("*").alias("copies"),
        *(F.first(c).alias(c) for c in ("t1", "t2", "place", "windows", "anchor")),
    ).checkpoint()
    twice = mixed.join(kinds.where("copies > 1").select("gram", "ctx"), ["gram", "ctx"])

    wanted = kinds.groupBy("t1", "t2").agg(
        F.collect_list(F.struct("gram", "copies", "place", "windows", "anchor")).alias("wanted")
    )
    ids = _keyed(long_ones, "doc_id").groupBy("t1", "t2").agg(F.min("doc_id").alias("one_id"))
    one_copy = wanted.join(ids, ["t1", "t2"])
    texts = _keyed(long_ones, "doc_id")
    copy = (
        texts.join(one_copy, ["t1", "t2"])
        .where(F.col("doc_id").eqNullSafe(F.col("one_id")))
        .select("t1", "t2", "bytes", "wanted")
    )
    pieces = copy.mapInArrow(partial(_pieces, min_bytes=min_bytes), _PIECE)

    sorted_out = []
    for finer in (*FINER, None):
        sort = partial(_sorted_pieces, min_bytes=min_bytes, finer=finer)
        dealt = pieces.repartition("key").sortWithinPartitions("key")
        out = dealt.mapInArrow(sort, _FOUND).checkpoint()
        sorted_out.append(out.where("start IS NOT NULL").select("t1", "t2", "start", "end"))
        pieces = out.where("start IS NULL").drop("start", "end")
        if pieces.isEmpty():
            break
    spans = alike.unionByName(twice.select("t1", "t2", *span))
    for part in sorted_out:
        spans = spans.unionByName(part)
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _merge(spans: list[dict]) -> list[list[int]]:
    merged: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    return merged


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """The columns before ``bytes, spans``, then what is left of the bytes."""
    for batch in batches:
        left, hashes, figures = [], [], []
        data_column, span_column = (c.to_pylist() for c in batch.columns[-2:])
        for data, spans in zip(data_column, span_column, strict=True):
            runs, kept, at = _merge(spans or []), [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            figures.append((len(data), len(data) - len(rest), len(runs)))
            left.append(rest.decode("utf-8", errors="ignore"))
            if digest:
                hashes.append(hashlib.sha256(rest).hexdigest())
        columns = [pa.array([f[i] for f in figures], pa.int64()) for i in range(3)]
        columns += [pa.array(hashes, pa.string())] * digest
        names = ["n_bytes", "n_removed", "n_spans", *["kept_sha256"] * digest, "kept"]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], *columns, pa.array(left, pa.string())],
            names=[*batch.schema.names[:-2], *names],
        )


def remove_repeats(
    docs: DataFrame, columns: list[str], min_bytes: int = 400, digest: bool = False
) -> DataFrame:
    """``columns`` of every row, ``n_bytes, n_removed, n_spans`` and ``kept``.

    With ``digest``, ``kept_sha256`` stands before ``kept``: the hex SHA-256 of the bytes left.

    Every byte covered by a string of ``min_bytes`` bytes that also starts at another
    place, in any row or the same, is removed; ``kept`` is the rest as text (a character
    cut in two goes).

    Null texts count as empty and shorter texts than ``min_bytes`` stay whole. Repeated
    rows repeat each other; ids may be null or repeated. An empty table gives an empty
    result. Columns not asked for are ignored.
    """
    kinds = docs.select(*columns).schema.fields
    extra = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    texts = [T.StructField(n, T.StringType()) for n in [*["kept_sha256"] * digest, "kept"]]
    schema = T.StructType([*kinds, *extra, *texts])
    renamed = [F.col(c).alias(f"column {i}") for i, c in enumerate(columns)]
    rows = _keyed(docs, *renamed).join(repeated_spans(docs, min_bytes), ["t1", "t2"], "left")
    given = [F.col(f"column {i}").alias(c) for i, c in enumerate(columns)]
    cut = partial(_cut, digest=digest)
    return rows.select(*given, F.col("bytes"), F.col("spans")).mapInArrow(cut, schema)
