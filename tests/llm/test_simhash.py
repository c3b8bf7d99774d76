import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import components, golay, simhash

DOCS = "doc_id bigint, text string, fp string, root int"


def _print(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text("aB é\n", max_size=60))
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text.encode(), 4) % (1 << 64) == _print(text)


def test_golay_is_perfect_and_keys_reach_two_bits():
    low, high, error = golay._tables()
    assert len(set(error.tolist())) == 2048
    random = np.random.default_rng(5)
    words = random.integers(0, 1 << 21, 500)
    flips = np.array([(1 << random.integers(21)) | (1 << random.integers(21)) for _ in words])
    a, in_a = golay.fuzzy_keys(words, 21)
    b, in_b = golay.fuzzy_keys(words ^ flips, 21)
    for i in range(len(words)):
        assert set(a[i][in_a[i]]) & set(b[i][in_b[i]])
        assert golay.decode(words[i : i + 1])[0] in a[i][in_a[i]]
    assert in_a.sum(axis=1).max() <= 6


def test_every_link_of_four_bits_meets():
    random = np.random.default_rng(9)
    for _ in range(400):
        x = random.integers(-(1 << 63), 1 << 63, dtype=np.int64)
        bits = random.choice(64, random.integers(0, 5), replace=False)
        y = np.bitwise_xor.reduce(np.array([x, *(np.int64(-(1 << 63)) if b == 63 else np.int64(1 << b) for b in bits)]))
        key, probe, row = simhash.keys_of(np.array([x, y], dtype=np.int64))
        met = {
            k for k in set(key[row == 0]) & set(key[row == 1])
            if not (probe[(row == 0) & (key == k)].all() and probe[(row == 1) & (key == k)].all())
        }
        assert met


def _components(prints):
    ids, parent = list(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _texts():
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(random.choice(words, 120)) for _ in range(25)]
    rows = []
    for text in base:
        for edits in range(6):
            w = text.split()
            for at in random.integers(0, len(w), edits):
                w[at] = "edit"
            rows.append(" ".join(w))
    return rows + ["", None, " \n", "a", "A", "a b c", *base[:5]]


def test_components_equal_brute_force(spark, monkeypatch):
    rows = [(i, t, "clash", 1) for i, t in enumerate(_texts())]
    expected = _components({i: _print(t) for i, t, *_ in rows})
    df = spark.createDataFrame(rows + [(None, "a b c", "", 1), (3, rows[3][1], "", 1)], DOCS)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == expected[r.doc_id]
            assert r.fp % (1 << 64) == _print(rows[r.doc_id][1])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_are_split_without_losing_links():
    random = np.random.default_rng(2)
    center = np.int64(123456789)
    fp = np.unique([center ^ np.int64(1 << a) ^ np.int64(1 << b) for a, b in random.integers(0, 60, (300, 2))])
    nodes = np.stack([fp, np.zeros_like(fp)], axis=1)
    a, b = simhash._forest(nodes, 64)
    assert len(a) == len(fp) - 1  # a forest, not all pairs
    assert (np.bitwise_count((a[:, 0] ^ b[:, 0]).view(np.uint64)) <= 4).all()


def test_hot_keys_are_dealt_again(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(_texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = simhash.fingerprints(df).collect()
    import pyarrow as pa

    fp = np.array(sorted({r.fp for r in prints}), dtype=np.int64)
    zero = np.zeros(len(fp), dtype=np.int64)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(zero), pa.array(zero > 0), pa.array(fp), pa.array(zero)], schema=simhash._KEYS_ARROW
    )
    out = pa.Table.from_batches(list(simhash._links(iter([batch, batch]), second_bits=64)))
    assert set(out["fp"].to_pylist()) == set(fp.tolist())
    assert set(out["hot_key"].to_pylist()) == {0}


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (5, 5)] + [(100, i) for i in range(101, 160)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 40: 30, **dict.fromkeys(range(100, 160), 100)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_group(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(4, text), (2, text), (2, text), (None, text), (None, "other words here"), (9, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, least int")
    kept = simhash.one_of_each_group(df, simhash.near_duplicates(df, 1, 5, 13)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted(
        [(2, text), (-1, "other words here"), (9, None)], key=lambda x: (x[0], x[1])
    ) or {(r.doc_id, r.text) for r in kept} == {(2, text), (None, "other words here"), (9, None)}
    assert len(kept) == 3
