import sys
from functools import partial

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.functions.vectors import cosine, l2_normalize, mean_pool
from gleaner.operators import knn
from gleaner.operators.embed import (
    HashingEmbedder, distinct_queries, embed_column, embed_queries, encode_texts,
    points_to_embed,
)
from gleaner.operators.prepare import prepare_articles

DIM = 16

# The tasks cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def data():
    """Random vectors; a third of them are copies of one, one is all zero."""
    rng = np.random.default_rng(3)
    corpus = rng.standard_normal((600, DIM)).astype(np.float32)
    corpus[::3] = corpus[0]
    corpus[7] = 0
    queries = rng.standard_normal((37, DIM)).astype(np.float32)
    queries[5] = corpus[0]
    queries[6] = 0
    return corpus, queries


def frame(spark, matrix, name, partitions=5):
    rows = [(n * 10, [float(x) for x in row]) for n, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>").repartition(partitions)


def brute_force(corpus, queries, k, threshold=None):
    a, b = queries.astype(float), corpus.astype(float)
    scale = np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None])
    scores = np.round(np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
    out = set()
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        for rank, i in enumerate(order, 1):
            if threshold is None or row[i] >= threshold:
                out.add((q * 10, i * 10, round(float(row[i]), 6), rank))
    return out


def as_set(df):
    return {(r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 30, 1000])
@pytest.mark.parametrize("threshold", [None, 0.4])
def test_batch_equals_brute_force(spark, data, k, threshold):
    corpus, queries = data
    found = knn.knn_batch(
        frame(spark, corpus, "id"), frame(spark, queries, "query_id"), k, threshold
    )
    assert as_set(found) == brute_force(corpus, queries, k, threshold)


@pytest.mark.parametrize("group_bytes", [1 << 20, 3000, 8 * DIM * 7])
def test_groups_and_small_batches_change_nothing(spark, data, group_bytes):
    corpus, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for threshold in (None, 0.4):
            found = knn.knn_grid(
                frame(spark, corpus, "id"), frame(spark, queries, "query_id"), 30, threshold, group_bytes
            )
            assert as_set(found) == brute_force(corpus, queries, 30, threshold)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_more_queries_than_a_block_stay_out_of_the_driver(spark, data, plan, monkeypatch):
    corpus, queries = frame(spark, data[0], "id"), frame(spark, data[1], "query_id")
    fetched = []
    whole = type(queries).toArrow
    monkeypatch.setattr(type(queries), "toArrow", lambda df: fetched.append(whole(df)) or fetched[-1])
    found = knn.knn_batch(corpus, queries, block_rows=10)
    assert as_set(found) == brute_force(*data, 30)
    assert [t.num_rows for t in fetched] == [11]  # only to see that there are more
    text = plan(found)
    assert "Broadcast" not in text and "Cartesian" not in text


def test_floors_keep_rows_in(spark, data):
    """A floor is the score a row must reach, ties included."""
    from gleaner.operators.knn import BestRows, PreparedQueries, PreparedRows, QueryBlock, score_into

    corpus, queries = data
    exact = sorted(brute_force(corpus, queries[:1], 30), key=lambda r: r[3])
    floor = np.array([round(exact[9][2] * 10**6)])
    best = BestRows(1, 30, None, floor)
    asked = PreparedQueries(QueryBlock(np.array([0]), queries[:1].astype(float)))
    score_into(best, np.array([0]), asked, PreparedRows(np.arange(len(corpus)) * 10, corpus.astype(float)))
    assert set(best.batch(np.array([0])).column(1).to_pylist()) == {r[1] for r in exact if r[2] >= exact[9][2]}


def test_best_cells_equal_all_cells_sorted():
    random = np.random.default_rng(4)
    for bits in (1, 2, 5, 9):
        projected = random.normal(size=bits)
        own = sum(1 << i for i in range(bits) if projected[i] > 0)
        cost = lambda c: sum(projected[i] ** 2 for i in range(bits) if (c ^ own) >> i & 1)  # noqa: B023, E731
        cells = sorted(range(2**bits), key=cost)
        assert knn.best_cells(projected, 2**bits) == cells
        assert knn.best_cells(projected, 3) == cells[:3]
    many = knn.best_cells(random.normal(size=60), 5000)
    assert len(set(many)) == 5000


def test_large_cells_are_split(spark, data, monkeypatch):
    corpus, queries = data
    planes = knn.random_planes(2, DIM)
    index = knn.with_cell(frame(spark, corpus, "id"), planes)
    for listed in (100, 0):
        monkeypatch.setattr(knn, "LISTED_CELLS", listed)
        found = knn.knn_lsh(
            index, frame(spark, queries, "query_id"), planes, 4, 10, group_bytes=8 * DIM * 9
        )
        assert as_set(found) == brute_force(corpus, queries, 10)


def test_grid_spreads_work_and_bounds_copies(spark, data, monkeypatch):
    """One group in memory is still many tasks; small groups do not multiply the queries."""
    parts, lanes = knn._grid(100_000, 100_000, 64, 36)
    assert parts * lanes >= 36 and max(parts, lanes) <= 12
    parts, lanes = knn._grid(10**7, 10**6, 1024, 36)
    assert 10**7 * 8 * 1024 / parts <= knn.GROUP_BYTES
    assert 10**13 * 1024 / (parts * lanes) <= knn.MOST_WORK
    corpus, queries = (frame(spark, m, n) for m, n in zip(data, ("id", "query_id"), strict=True))
    few = knn.knn_grid(corpus, queries, group_bytes=8 * DIM * 7).rdd.getNumPartitions()
    assert few <= 4 * 2
    monkeypatch.setattr(knn, "LEAST_WORK", 1)
    seen = []
    dealt = type(corpus).repartitionById
    monkeypatch.setattr(
        type(corpus), "repartitionById", lambda df, n, c: seen.append(n) or dealt(df, n, c)
    )
    for group_bytes in (knn.GROUP_BYTES, 3000):
        found = knn.knn_grid(corpus, queries, 30, None, group_bytes)
        assert as_set(found) == brute_force(*data, 30)
    assert len(seen) == 3 and min(seen) >= 8


def test_queries_of_a_cell_are_split(spark, data, monkeypatch):
    monkeypatch.setattr(knn, "LANE_ROWS", 10)
    corpus, queries = data
    planes = knn.random_planes(2, DIM)
    index = knn.with_cell(frame(spark, corpus, "id"), planes)
    found = knn.knn_lsh(index, frame(spark, queries, "query_id"), planes, 4, 10)
    assert as_set(found) == brute_force(corpus, queries, 10)
    monkeypatch.setattr(knn, "TASK_ROWS", 100)
    found = knn.knn_lsh(index, frame(spark, queries, "query_id"), planes, 4, 10, group_bytes=8 * DIM * 99)
    assert as_set(found) == brute_force(corpus, queries, 10)


def test_one_equals_batch(spark, data):
    corpus, queries = data
    vector = F.lit([float(x) for x in queries[2]]).cast("array<double>")
    for threshold in (None, 0.3):
        got = knn.knn_one(frame(spark, corpus, "id"), vector, 20, threshold).collect()
        expected = brute_force(corpus, queries[2:3], 20, threshold)
        assert {(r["id"], r["score"]) for r in got} == {(i, s) for _, i, s, _ in expected}


def test_one_is_a_top_k_plan(spark, data, plan):
    vector = F.lit([1.0] * DIM)
    assert "TakeOrderedAndProject" in plan(knn.knn_one(frame(spark, data[0], "id"), vector))


def test_corpus_is_not_shuffled(spark, data, plan, scratch):
    path = scratch("corpus")
    frame(spark, data[0], "id").write.parquet(path)
    text = plan(knn.knn_batch(spark.read.parquet(path), frame(spark, data[1], "query_id")))
    assert text.count("Exchange") == 1 and "hashpartitioning(query_id" in text
    assert text.count("WindowGroupLimit") == 2


def test_no_queries_or_no_corpus(spark, data):
    corpus, queries = (frame(spark, m, n) for m, n in zip(data, ("id", "query_id")))
    assert knn.knn_batch(corpus, queries.where("false")).count() == 0
    assert knn.knn_batch(corpus.where("false"), queries).count() == 0


def test_ragged_vectors_are_an_error(spark, data):
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, vector array<float>")
    with pytest.raises(Exception, match="dimension"):
        knn.knn_grid(bad, frame(spark, data[1], "query_id")).collect()
    with pytest.raises(Exception, match="dimension"):
        knn.knn_batch(bad.coalesce(1), frame(spark, data[1], "query_id")).collect()


def test_lsh_recall_and_exactness(spark, scratch, data):
    corpus, queries = data
    planes = knn.random_planes(5, DIM, seed=1)
    path = scratch("cells")
    knn.write_cells(frame(spark, corpus, "id"), planes, path)
    index = spark.read.parquet(path)
    asked = frame(spark, queries, "query_id")
    exact = brute_force(corpus, queries, 10)
    assert as_set(knn.knn_lsh(index, asked, planes, 32, 10)) == exact
    some = {r[:2] for r in as_set(knn.knn_lsh(index, asked, planes, 16, 10))}
    close = {r[:2] for r in exact if r[2] >= 0.5}
    assert len(some & close) >= 0.8 * len(close)


def test_lsh_reads_only_probed_cells(spark, scratch, data, plan):
    planes = knn.random_planes(4, DIM)
    path = scratch("cells")
    knn.write_cells(frame(spark, data[0], "id"), planes, path)
    one = frame(spark, data[1][:1], "query_id")
    text = plan(knn.knn_lsh(spark.read.parquet(path), one, planes, 2))
    assert "PartitionFilters" in text and "cell" in text.split("PartitionFilters")[1][:80]


def test_threshold_is_monotone_and_stats(spark, data):
    corpus, queries = frame(spark, data[0], "id"), frame(spark, data[1], "query_id")
    low, high = (as_set(knn.knn_batch(corpus, queries, 30, t)) for t in (0.3, 0.5))
    assert high <= low
    stats = knn.score_stats(knn.knn_batch(corpus, queries, 30, 0.3)).collect()
    for r in stats:
        scores = [s for q, _, s, _ in low if q == r["query_id"]]
        assert (len(scores), min(scores), max(scores)) == tuple(r)[1:]


def test_best_when_empty(spark, data):
    corpus, queries = frame(spark, data[0], "id"), frame(spark, data[1], "query_id")
    best = knn.best_when_empty(knn.knn_batch(corpus, queries, 1), queries, 0.7).collect()
    expected = {q: s for q, _, s, _ in brute_force(*data, 1) if s < 0.7}
    assert {r["query_id"]: r["best_score"] for r in best} == expected
    none = knn.knn_batch(corpus.where("false"), queries, 1)
    rows = knn.best_when_empty(none, queries, 0.7).collect()
    assert len(rows) == 37 and {r["best_score"] for r in rows} == {None}


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 6.0]], [3.0, 4.0], [0.0, 0.0])],
        "t array<array<float>>, v array<float>, z array<float>",
    )
    row = df.select(
        mean_pool(F.col("t")).alias("mean"),
        l2_normalize(F.col("v")).alias("unit"),
        l2_normalize(F.col("z")).alias("zero"),
        cosine(F.col("v"), F.col("z")).alias("none"),
        cosine(F.col("v"), F.col("v")).alias("same"),
    ).first()
    assert row["mean"] == [2.0, 4.0] and row["unit"] == [0.6, 0.8]
    assert row["zero"] == [0.0, 0.0] and row["none"] == 0.0 and row["same"] == 1.0


class Model:
    def __init__(self, out):
        self.out = out

    def embed_batch(self, texts):
        return self.out(texts)


def test_embedder_output_is_checked():
    ok = encode_texts(Model(lambda t: [[1, 2]] * len(t)), ["a", "b"], None)
    assert ok.shape == (2, 2) and ok.dtype == np.float32
    pooled = encode_texts(Model(lambda t: [[[1, 2], [3, 6]], [[5, 5]]]), ["a", "b"], 2)
    assert pooled.tolist() == [[2, 4], [5, 5]]
    with pytest.raises(ValueError, match="2 vectors returned for 1"):
        encode_texts(Model(lambda t: [[1], [2]]), ["a"], None)
    with pytest.raises(ValueError, match="different dimensions"):
        encode_texts(Model(lambda t: [[1], [2, 3]]), ["a", "b"], None)
    with pytest.raises(ValueError, match="expected 3"):
        encode_texts(Model(lambda t: [[1, 2]]), ["a"], 3)


def test_hashing_embedder():
    model = HashingEmbedder(64)
    a, b, empty = model.embed_batch(["Cat cat dog.", "dog, CAT cat", ""])
    assert (a == b).all() and a.sum() == 3 and empty.sum() == 0
    unit = HashingEmbedder(64, normalize=True).embed_batch(["a b", ""])
    assert np.isclose(np.linalg.norm(unit[0]), 1) and unit[1].sum() == 0


@pytest.mark.parametrize("normalize", [False, True])
@pytest.mark.parametrize("dim", [1, 5, 64])
def test_hashing_embedder_as_an_expression(spark, plan, dim, normalize):
    words = "a bb Ccc đồng ngày ÉTÉ 東京 naïve x1 -- '' cat".split()
    rng = np.random.default_rng(dim)
    texts = [" ".join(rng.choice(words, n)) for n in range(40)]
    texts += ["", None, "  ", ".,;:!?\t\r\n", "Cat cat dog.", ",cat,", "a" * 5000, "ab cd " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    factory = partial(HashingEmbedder, dim, normalize)
    native = embed_column(df, "t", factory, dim)
    assert "Python" not in plan(native) and "Arrow" not in plan(native)
    assert dict(native.dtypes)["vector"] == "array<float>"
    got = [r["vector"] for r in native.orderBy("id").collect()]
    expected = [r["vector"] for r in embed_column(df, "t", lambda: factory()).orderBy("id").collect()]
    assert np.allclose(got, expected, rtol=1e-6, atol=0)
    with pytest.raises(ValueError, match="expected"):
        embed_column(df, "t", factory, dim + 1)


def test_embed_column_keeps_order_and_batches(spark):
    sizes = []

    def factory():
        return Model(lambda t: [[len(x), len(t)] for x in t])

    df = spark.range(100).coalesce(1).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"), "id")
    rows = embed_column(df, "t", factory, batch_size=32).collect()
    assert [r["vector"][0] for r in rows] == list(range(100))
    assert {r["vector"][1] for r in rows} == {32.0, 4.0}


def test_embedding_text_and_payload(raw_rows):
    raw = raw_rows(
        [
            {"link": "u1", "tieu_de": " t ", "summary": None, "ngay_dang": ""},
            {"link": "u2", "tieu_de": None, "summary": "", "noi_dung": "never"},
            {"link": "u3", "tieu_de": "a", "summary": "b"},
        ]
    )
    rows = points_to_embed(prepare_articles(raw)).collect()
    assert sorted(r["text"] for r in rows) == ["", "a\nb", "t"]
    empty = next(r for r in rows if r["text"] == "")
    assert empty["payload"]["id"] == empty["id"] and empty["payload"]["summary"] is None
    dated = next(r for r in rows if r["text"] == "t")
    assert dated["payload"]["publish_date"] is None and dated["payload"]["title"] == " t "


def test_distinct_queries_and_prefix(spark):
    rows = [(5, "b "), (2, " b"), (3, "B"), (4, "  "), (1, None)]
    queries = spark.createDataFrame(rows, "query_id bigint, query string")
    got = {tuple(r) for r in distinct_queries(queries).collect()}
    assert got == {("b", 2, " b", 2), ("B", 3, "B", 1)}
    factory = lambda: Model(lambda t: [[len(x)] for x in t])
    got = embed_queries(queries.where("query_id > 2"), factory, "abc").collect()
    assert {(r["query_id"], r["vector"][0]) for r in got} == {(5, 5), (3, 4), (4, 5)}
