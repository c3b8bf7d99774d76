import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import vptree
from gleaner.llm.queries import op10_vptree

VECTORS = "vec_id bigint, vector array<float>, score string, rank int"


def _rows(random, n=700, d=8):
    rows = [(i, random.normal(size=d).astype("f4").tolist(), "", 0) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, "", 0) for i in range(60)]  # many equal vectors
    bad = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [None] + [1.0] * (d - 1), []]
    rows += [(2000 + 20 * i, v, "", 0) for i, v in enumerate(bad)]
    rows += [(None, same, "", 0), (5000, [1.0, 2.0], "", 0), (5020, [2.0, 1.0], "", 0)]
    return rows


def _brute(rows, k):
    ok = [
        (i, np.array(v, dtype=float)) for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            scores = [(-float(np.einsum("i,i->", x, y)), i) for i, y in ok if i != q and len(y) == len(x)]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


def _search(spark, rows, factor, k=20):
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id])
    return got


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptree, "MIN_SHARD_ROWS", 100)  # several shards
    rows = _rows(np.random.default_rng(0))
    assert _search(spark, rows, 1.0) == _brute(rows, 20)


@pytest.mark.parametrize("unit", [True, False])
def test_tuned_factor_recalls_most(spark, unit):
    rows = _rows(np.random.default_rng(1), 2500, 24)
    if unit:
        rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), s, n) for i, v, s, n in rows[:2500]]
    got, expected = _search(spark, rows, None), _brute(rows, 20)
    found = [len(set(got[q]) & set(e)) / len(e) for q, e in expected.items() if e]
    assert np.mean(found) >= 0.9


def test_less_factor_prunes_more():
    random = np.random.default_rng(2)
    points = np.column_stack([random.normal(size=(4000, 3)), np.zeros(4000)])
    scanned = {}
    for factor in (0.1, 1.0):
        tree, seen = vptree.VpTree(points), []
        scan = tree._scan
        tree._scan = lambda rows, active: (seen.append(len(rows) * len(active)), scan(rows, active))  # noqa: B023
        tree.search(points[:50], np.arange(50), np.arange(4000), 5, factor)
        scanned[factor] = sum(seen)
    assert scanned[0.1] < scanned[1.0] < 50 * 4000


@pytest.mark.parametrize("rows", [[], [(1, [1.0], "", 0)], [(20, None, "", 0)], [(20, [1.0], "", 0)]])
def test_nothing_to_find(spark, rows):
    assert _search(spark, rows, 1.0) == {}


def test_query_recall(spark, sf_dir="/root/testdata/sf0.001"):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in op10_vptree(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = _brute(rows, 20)
    assert np.mean([len(got[q] & set(e)) / 20 for q, e in expected.items()]) >= 0.9


def test_magnitudes_far_apart(spark):
    """One very long vector, and very short ones, leave the others their neighbours."""
    random = np.random.default_rng(5)
    vectors = [random.normal(size=6) for _ in range(300)] + [np.array([1e160, 0, 0, 0, 0, 0])]
    vectors += [random.normal(size=6) * 1e-200 for _ in range(29)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, vector array<double>")
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 330, 20))
    for q, found in got.items():
        scores = [(-float(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q]
        assert found == [i for _, i in sorted(scores)[:20]]


@pytest.mark.parametrize("kind", ["unit", "clusters", "one long"])
def test_default_is_exact_on_any_rows(spark, kind):
    """Also where the first batch of a shard ends with its first query."""
    random = np.random.default_rng(11)
    vectors = random.normal(size=(1500, 24))
    if kind == "unit":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    elif kind == "clusters":
        vectors = vectors[:30][random.integers(30, size=1500)] + 0.05 * vectors
    else:
        vectors[7] *= 1e8
    rows = [(i, v.astype("f4").tolist(), "", 0) for i, v in enumerate(vectors)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, len(rows) + 1)
    try:
        got = _search(spark, rows, None)
    finally:
        spark.conf.unset(size)
    exact = [(i, np.array(v, dtype=float)) for i, v, *_ in rows]
    for q, x in exact[::20]:
        scores = sorted((-float(np.einsum("i,i->", x, y)), i) for i, y in exact if i != q)
        assert got[q] == [i for _, i in scores[:20]]
