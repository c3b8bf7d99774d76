import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import repeats
from gleaner.llm.suffixes import SuffixSorter

DOCS = "doc_id bigint, text string, kept int, t1 string"


def _expected(texts, size):
    """Brute force over all windows: (bytes, removed, runs, digest of the rest) per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + size] for d in data for s in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for s in range(len(d) - size + 1):
            if seen[d[s : s + size]] > 1:
                gone[s : s + size] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if d else 0
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def _texts(random, n=60, alphabet="abcdefgh éß"):
    piece = lambda k: "".join(random.choice(list(alphabet), k))
    shared = [piece(k) for k in (90, 150, 260, 399, 700)]
    texts = []
    for i in range(n):
        parts = [piece(int(random.integers(0, 200)))]
        for _ in range(int(random.integers(0, 3))):
            s = shared[random.integers(len(shared))]
            a = int(random.integers(0, 40))
            s = s[a:] if random.integers(2) else s
            if random.integers(3) == 0:
                at = int(random.integers(len(s)))
                s = s[:at] + "#" + s[at + 1 :]
            parts += [s, piece(int(random.integers(0, 60)))]
        texts.append("".join(parts))
    return texts + [None, "", "short", texts[3], texts[3], "x" * 1500, "ab" * 700, "x" * 399 + "y" + "x" * 450]


def _removed(spark, texts, size):
    df = spark.createDataFrame([(i, t, 1, "") for i, t in enumerate(texts)], DOCS)
    rows = repeats.remove_repeats(df, ["doc_id"], size, digest=True).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("size", [100, 400])
def test_removed_bytes_equal_brute_force(spark, size):
    texts = _texts(np.random.default_rng(size))
    got = _removed(spark, texts, size)
    assert [got[i] for i in range(len(texts))] == _expected(texts, size)


def test_documents_equal_brute_force(spark, sf_dir="/root/testdata/sf0.001"):
    from gleaner.llm.queries import op1_suffix_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_suffix_dedup(spark, sf_dir).collect()}
    for d, e in zip(docs, _expected([d.text for d in docs], 400), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == e


@pytest.mark.parametrize("finer", [16, 1, None])
def test_large_anchors_are_dealt_again(spark, finer, monkeypatch):
    """Stretches handed on in finer nodes give the same bytes."""
    random = np.random.default_rng(7)
    texts = [t for t in _texts(random, 25) if t]
    size = 100
    rows = []
    for i, t in enumerate(texts):
        d = t.encode()
        for s, k, p in repeats.stretches(d, size):
            rows.append((hash(d[s + p : s + p + repeats.GRAM]), 1, i, 0, s, k, p, d[s : s + k - 1 + size]))
    if finer:
        rows = [f for r in rows for f in repeats._finer(r, finer, size)]
    rows.sort(key=lambda r: r[0])
    gone = {i: set() for i in range(len(texts))}
    for t1, _, a, b in repeats.repeated_windows(rows, size):
        gone[t1].update(range(a, b))
    assert [len(gone[i]) for i in range(len(texts))] == [e[1] for e in _expected(texts, size)]


def test_hot_anchor_through_spark(spark, monkeypatch):
    """Workers fork from here, so a small buffer reaches them as an argument would."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "TASK_BYTES", 2000)
    random = np.random.default_rng(4)
    line = "".join(random.choice(list("abcdef"), 80))
    texts = [line + "".join(random.choice(list("abcdef"), 90)) for _ in range(30)]
    texts += [texts[0] + "!", texts[1] + "?"]
    size, pieces = 100, []
    for i, t in enumerate(texts):
        d = t.encode()
        for s, k, p in repeats.stretches(d, size):
            key = int(np.frombuffer(hashlib.md5(d[s + p : s + p + 32]).digest()[:8], "<i8")[0])
            pieces.append((key, 1, i, 0, s, k, p, d[s : s + k - 1 + size]))
    found = []
    for finer in (*repeats.FINER, None):
        batch = repeats._piece_batch(sorted(pieces))
        out = pa.Table.from_batches(list(repeats._sorted_pieces(iter([batch]), size, finer))).to_pylist()
        found += [(r["t1"], r["start"], r["end"]) for r in out if r["start"] is not None]
        pieces = [tuple(r[f.name] for f in repeats._PIECE_ARROW) for r in out if r["start"] is None]
        if not pieces:
            break
    gone = {i: set() for i in range(len(texts))}
    for i, a, b in found:
        gone[i].update(range(a, b))
    assert [len(gone[i]) for i in range(len(texts))] == [e[1] for e in _expected(texts, size)]


def test_text_form_and_empty_table(spark):
    line = "é" * 60
    rows = [(1, "a" + line, 0, ""), (2, line + "b", 0, ""), (None, None, 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.new for r in repeats.remove_repeats(df, ["doc_id", "t1"], 100).withColumnRenamed("kept", "new").collect()}
    assert got == {1: "a", 2: "b", None: ""}
    assert repeats.remove_repeats(df.limit(0), ["doc_id"], 100).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.integers(1, 12))
def test_suffix_sort(text, length):
    data = np.frombuffer((text + "z" * length).encode(), dtype=np.uint8)
    starts = np.arange(len(text))
    segment = np.sort(starts % 2)
    items = np.concatenate([starts[starts % 2 == 0], starts[starts % 2 == 1]])
    order, shared = SuffixSorter(data).sort(segment, items, length)
    cut = lambda i: bytes(data[items[i] : items[i] + length])
    for part in (0, 1):
        mine = [i for i in order if segment[i] == part]
        assert [cut(i) for i in mine] == sorted(cut(i) for i in mine)
    for n in range(1, len(order)):
        if segment[order[n]] == segment[order[n - 1]]:
            a, b = cut(order[n - 1]), cut(order[n])
            same = next((k for k in range(length) if a[k] != b[k]), length)
            assert shared[n] == same
