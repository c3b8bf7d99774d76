"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. If two fingerprints
differ in four bits or fewer, then two of the three segments differ either in one bit
at most each, or in none and in two at most (pigeonhole). The first kind meet under a
pair of codewords: one side is found under the codewords of its segments, the other
looks under all codewords one bit away. The second kind meet under an equal segment
and a codeword near the other one. Each meeting is verified on the whole fingerprints.

Documents of one fingerprint are one node, so copies never multiply. Inside a key only
links that join something new are kept for larger groups, never all pairs; keys with
more members than ``BLOCK`` are spread over several tasks, block pair by block pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.components import connected_components
from gleaner.llm.golay import decode, fuzzy_keys
from gleaner.llm.workers import free_name, ready

SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits)
SMALL = 48
BLOCK = 8192
SPLIT = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the hashes of all ``width``-word shingles, repeats included."""
    # bytes.lower and bytes.split know ASCII only, as the definition wants.
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) > width:
        spans = zip([0, *ends], ends[width - 1 :], strict=False)
        digests = [xxhash.xxh64_digest(line[a : b - 1], SEED) for a, b in spans]
    else:
        digests = [xxhash.xxh64_digest(line, SEED)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), _CHUNK):
        raw = np.frombuffer(b"".join(digests[at : at + _CHUNK]), dtype=np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big", signed=True)


_PRINTS = "doc_id bigint, text_hash bigint, fp bigint, second bigint"
_PRINTS_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in _PRINTS.split(", ")])


def _fingerprints(
    batches: Iterator[pa.RecordBatch], width: int, second_width: int | None
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        prints = [fingerprint(t, width) for t in texts]
        seconds = [fingerprint(t, second_width) if second_width else 0 for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(prints, pa.int64()), pa.array(seconds, pa.int64())],
            schema=_PRINTS_ARROW,
        )


def fingerprints(docs: DataFrame, width: int = 4, second_width: int | None = None) -> DataFrame:
    """``doc_id, text_hash, fp, second`` per row; null texts are empty, with fingerprint zero.

    ``second`` is a fingerprint of another shingle width, or zero.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("text"),
    )
    prints = partial(_fingerprints, width=width, second_width=second_width)
    return rows.mapInArrow(prints, _PRINTS)


_KEYS = "key bigint, probe boolean, fp bigint, second bigint"
_KEYS_ARROW = pa.schema(
    [("key", pa.int64()), ("probe", pa.bool_()), ("fp", pa.int64()), ("second", pa.int64())]
)
_PAIRS = tuple(combinations(range(3), 2))
_ORDERED = tuple(permutations(range(3), 2))


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, probe, row) for signed fingerprints; a key's high bits tell its kind."""
    bits = fp.astype(np.int64).view(np.uint64)
    words = [
        ((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64)
        for at, size in SEGMENTS
    ]
    own = [decode(w).astype(np.int64) for w in words]
    near = [fuzzy_keys(w, size) for w, (_, size) in zip(words, SEGMENTS, strict=True)]
    rows = np.arange(len(fp))
    keys, probes, which = [], [], []

    def put(kind: int, key: np.ndarray, probe: bool, row: np.ndarray) -> None:
        keys.append(key | np.int64(kind << 40))
        probes.append(np.full(len(row), probe))
        which.append(row)

    for kind, (s, t) in enumerate(_PAIRS):
        put(kind, own[s] << 12 | own[t], False, rows)
        (a, in_a), (b, in_b) = near[s], near[t]
        both = in_a[:, :, None] & in_b[:, None, :]
        key = a.astype(np.int64)[:, :, None] << 12 | b.astype(np.int64)[:, None, :]
        put(kind, key[both], True, np.nonzero(both)[0])
    for kind, (s, t) in enumerate(_ORDERED, len(_PAIRS)):
        b, in_b = near[t]
        key = words[s][:, None] << 12 | b.astype(np.int64)
        put(kind, key[in_b], False, np.nonzero(in_b)[0])
    return np.concatenate(keys), np.concatenate(probes), np.concatenate(which)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, second = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for at in range(0, len(fp), 4096):
            part, other = fp[at : at + 4096], second[at : at + 4096]
            key, probe, row = keys_of(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(probe), pa.array(part[row]), pa.array(other[row])],
                schema=_KEYS_ARROW,
            )


def _near(a: np.ndarray, b: np.ndarray, second_bits: int) -> np.ndarray:
    """Whether rows of (fp, second) link."""
    differ = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
    return (differ[..., 0] <= MAX_BITS) & (differ[..., 1] <= second_bits)


def _forest(nodes: np.ndarray, second_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links connect within one group of (fp, second)."""
    left, right = [nodes[:0]], [nodes[:0]]
    todo = nodes
    while len(todo):
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            node = frontier.pop()
            near = _near(todo, node, second_bits)
            if near.any():
                found = todo[near]
                left.append(np.broadcast_to(node, found.shape))
                right.append(found)
                frontier.extend(found)
                todo = todo[~near]
    return np.concatenate(left), np.concatenate(right)


_LINKS = "fp bigint, second bigint, other_fp bigint, other_second bigint, hot_key bigint"
_LINKS_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in _LINKS.split(", ")])


def _links_of(
    key: np.ndarray, probe: np.ndarray, nodes: np.ndarray, second_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys; rows are sorted by key, then probe."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    left, right = [nodes[:0]], [nodes[:0]]
    of_row = np.repeat(size, size)
    base = np.flatnonzero(~probe & (of_row > 1) & (of_row <= SMALL))
    shift = 1
    while len(base):
        base = base[base + shift < len(key)]
        base = base[key[base] == key[base + shift]]
        near = _near(nodes[base], nodes[base + shift], second_bits)
        left.append(nodes[base[near]])
        right.append(nodes[base[near] + shift])
        shift += 1
    for at, n in zip(first[size > SMALL], size[size > SMALL], strict=True):
        a, b = _forest(np.unique(nodes[at : at + n], axis=0), second_bits)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch], second_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each key's group; members of a group above ``BLOCK`` are handed on."""
    held: list[tuple] = []
    held_rows = 0
    hot = None

    def linked(key: np.ndarray, probe: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        pairs = np.concatenate(_links_of(key, probe, nodes, second_bits), axis=1)
        pairs = np.unique(pairs[(pairs[:, :2] != pairs[:, 2:]).any(axis=1)], axis=0)
        columns = [pa.array(np.ascontiguousarray(c)) for c in pairs.T]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.nulls(len(pairs), pa.int64())], schema=_LINKS_ARROW
        )

    def handed_on(key: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        fp, second = (pa.array(np.ascontiguousarray(c)) for c in nodes.T)
        return pa.RecordBatch.from_arrays([fp, second, fp, second, pa.array(key)], schema=_LINKS_ARROW)

    for batch in batches:
        key, probe, fp, second = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        nodes = np.stack([fp, second], axis=1)
        if hot is not None:
            same = key == hot
            if same.any():
                yield handed_on(key[same], nodes[same])
            if same.all():
                continue
            key, probe, nodes, hot = key[~same], probe[~same], nodes[~same], None
        held.append((key, probe, nodes))
        held_rows += len(key)
        if held_rows < 8 * BLOCK:
            continue
        key, probe, nodes = (np.concatenate(c) for c in zip(*held, strict=True))
        last = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if len(key) - last > BLOCK:
            hot = key[-1]
            yield handed_on(key[last:], nodes[last:])
            held, held_rows = [], 0
        else:
            held, held_rows = [(key[last:], probe[last:], nodes[last:])], len(key) - last
        if last:
            yield linked(key[:last], probe[:last], nodes[:last])
    if held_rows:
        yield linked(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _split_hot(hot: DataFrame, level: int) -> DataFrame:
    """Members of large groups under every pair of blocks their own block is in."""
    block = F.pmod(F.xxhash64("fp", "second", F.lit(level)), F.lit(SPLIT)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    return (
        hot.select("fp", "second", "hot_key", block.alias("i"))
        .distinct()
        .withColumn("j", other)
        .select(
            F.xxhash64("hot_key", F.least("i", "j"), F.greatest("i", "j")).alias("key"),
            F.lit(False).alias("probe"),
            "fp",
            "second",
        )
    )


def _node(fp: str, second: str, by_fp: bool) -> Column:
    return F.col(fp) if by_fp else F.xxhash64(fp, second)


def link_fingerprints(prints: DataFrame, second_bits: int | None = None) -> DataFrame:
    """Links (a, b) of nodes that connect all fingerprints which link.

    A node is the fingerprint, or a hash of it and ``second`` if that counts as well.
    """
    ready(prints.sparkSession)
    by_fp = second_bits is None
    nodes = prints.select("fp", "second").distinct()
    rows = nodes.mapInArrow(_key_rows, _KEYS)
    link = partial(_links, second_bits=64 if by_fp else second_bits)
    links, level = None, 0
    while True:
        dealt = rows.repartition("key").sortWithinPartitions("key", "probe")
        found = dealt.mapInArrow(link, _LINKS).checkpoint()
        own = found.where("hot_key IS NULL").select(
            _node("fp", "second", by_fp).alias("a"),
            _node("other_fp", "other_second", by_fp).alias("b"),
        )
        links = own if links is None else links.unionByName(own)
        hot = found.where("hot_key IS NOT NULL")
        if hot.isEmpty():
            return links
        rows, level = _split_hot(hot, level), level + 1


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    second_width: int | None = None,
    second_bits: int | None = None,
) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` per row of ``docs``.

    Fingerprints of ``width``-word shingles link at four or fewer differing bits; with
    ``second_width``, fingerprints of that width must also differ in ``second_bits`` at
    most. ``root`` is the smallest node reachable over links (a fingerprint, or a hash
    of both), ``component_id`` the smallest doc_id of any document reachable.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows
    stay; null ids do not count for the smallest id, and a group of null ids only has a
    null id. An empty table gives an empty result. Other columns are ignored.
    """
    ready(docs.sparkSession)
    prints = fingerprints(docs, width, second_width).withColumn(
        "node", _node("fp", "second", second_width is None)
    )
    prints = prints.checkpoint()
    links = link_fingerprints(prints, second_bits if second_width else None)
    roots = connected_components(links)
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node")).checkpoint()
    # Checkpointed, the join below has an exchange on both sides and can split a hot root.
    named = nodes.groupBy("root").agg(F.min("least_id").alias("component_id")).checkpoint()
    labels = nodes.select("node", "root").join(named, "root")
    return prints.join(labels, "node").select(
        "doc_id", "text_hash", "fp", "root", "component_id"
    )


def one_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each group, all columns kept.

    ``groups`` is the result of ``near_duplicates`` over the same rows. Rows alike in
    id and text are one row; a null id is only kept where its group has no other.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least")
    kept = groups.groupBy("root").agg(least).select("least.doc_id", "least.text_hash")
    names = [free_name(docs, f"key {part}") for part in ("id", "null", "hash")]
    keys = [
        F.coalesce("doc_id", F.lit(0).cast("long")).alias(names[0]),
        F.col("doc_id").isNull().alias(names[1]),
    ]
    kept = kept.select(*keys, F.col("text_hash").alias(names[2])).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("*", *keys, F.xxhash64(text).alias(names[2]))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)
