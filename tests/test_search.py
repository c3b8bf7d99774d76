import math
import sys
from functools import partial

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators import bounds, knn
from gleaner.operators import rerank as reranking
from gleaner.operators.audit import index_audit, orphan_ids, pending_articles, pending_ids
from gleaner.operators.embed import HashingEmbedder
from gleaner.operators.hydrate import lookup_content
from gleaner.operators.prepare import prepare_articles
from gleaner.operators.rerank import apply_scores, extract_score, passage, rerank, score_or_none
from gleaner.plans import build_vectors as building
from gleaner.plans.build_vectors import FORCE, RECREATE, BuildReport, build_vectors
from gleaner.plans.semantic_search import as_list_items, list_envelopes, semantic_search
from gleaner.sources.article_store import ArticleStore
from gleaner.sources.vector_store import VectorStore
from gleaner.streaming.ingest import ingest_batch, read_drops, start_ingest

DIM = 32

# The tasks cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def model():
    return HashingEmbedder(DIM)


def texts(n):
    return [" ".join(WORDS[(i * 3 + j * (i % 5 + 1)) % 8] for j in range(6)) for i in range(n)]


@pytest.fixture
def raw(raw_rows):
    return raw_rows(
        [
            {"link": f"u{i}", "tieu_de": f"title {i}", "summary": text, "noi_dung": f"content {i}"}
            for i, text in enumerate(texts(40))
        ]
    )


@pytest.fixture
def articles(raw):
    return prepare_articles(raw).persist()


@pytest.fixture
def store(spark, scratch):
    return VectorStore(spark, scratch("vectors"))


def queries_of(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id bigint, query string")


# --- store ---


def points(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, x float")
    payload = F.struct("id", *[F.lit(None).cast("string").alias(c)
                               for c in ("title", "summary", "publish_date")])
    return df.select("id", F.array("x", "x").alias("vector"), payload.alias("payload"))


def stored(store):
    return {r["id"]: r["vector"][0] for r in store.read().collect()}


def test_store_life_cycle(spark, store):
    assert not store.exists() and store.count() == 0 and store.dim() is None
    assert store.ids().count() == 0 and store.read().count() == 0
    with pytest.raises(ValueError, match="does not exist"):
        store.upsert(points(spark, [(1, 1.0)]))
    store.ensure(2)
    store.ensure(2)
    with pytest.raises(ValueError, match="dimension 2, not 3"):
        store.ensure(3)
    store.upsert(points(spark, [(1, 1.0), (2, 2.0)]), replace=False)
    store.upsert(points(spark, [(3, 3.0)]), replace=False)
    assert stored(store) == {1: 1, 2: 2, 3: 3} and store.count() == 3
    for _ in range(2):  # twice is as good as once
        store.upsert(points(spark, [(2, 20.0), (4, 4.0)]))
    expected = {1: 1, 2: 20, 3: 3, 4: 4}
    assert stored(store) == expected and store.count() == 4
    assert sorted(r["id"] for r in store.ids().collect()) == [1, 2, 3, 4]
    store.compact()
    assert stored(store) == expected and store.count() == 4
    store.upsert(points(spark, [(5, 5.0), (5, 5.0)]))
    assert store.count() == 5
    store.recreate(2)
    assert store.exists() and stored(store) == {} and store.count() == 0


def test_wrong_dimension_is_not_stored(spark, store):
    store.ensure(3)
    with pytest.raises(Exception, match="expected 3"):
        store.upsert(points(spark, [(1, 1.0)]))
    assert store.count() == 0 and stored(store) == {}


def test_uncommitted_write_is_invisible(spark, store):
    store.ensure(2)
    points(spark, [(9, 9.0)]).write.parquet(store._folder(0, 1, "crashed"))
    assert stored(store) == {}
    store.upsert(points(spark, [(1, 1.0)]))
    assert stored(store) == {1: 1}


def test_store_survives_a_crash_in_its_first_commit(spark, store):
    import os

    os.makedirs(f"{store.path}/log/_temporary")
    assert not store.exists() and store.count() == 0
    store.ensure(2)
    store.upsert(points(spark, [(1, 1.0)]))
    assert stored(store) == {1: 1}


def test_last_point_of_a_call_wins(spark, store):
    store.ensure(2)
    many = points(spark, [(1, 1.0), (1, 3.0), (1, 2.0), (2, 5.0)])
    store.upsert(many.withColumn("nth", F.element_at("vector", 1)), order="nth")
    assert stored(store) == {1: 3, 2: 5}


def test_scorer_sees_all_candidates_of_a_query(spark):
    from gleaner.operators.rerank import _score_in_tasks

    class Counting:
        def score(self, query, passages):
            return [float(len(passages))] * len(passages)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(q, f"query {q}", f"p{i}", i) for q in range(12) for i in range(5 + q)]
        pairs = spark.createDataFrame(rows, "query_id bigint, query string, passage string, rank int")
        scored = _score_in_tasks(pairs, Counting).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(scored) == len(rows)
    assert all(r.new_score == 5 + r.query_id for r in scored)


def test_stored_pages_read_the_buckets_of_their_rows(spark, scratch, articles, plan):
    from gleaner.operators.listing import latest_news

    store = ArticleStore(spark, scratch("articles"), buckets=8)
    store.append(articles)
    text = plan(latest_news(store.read(), limit=2))
    scans = [line for line in text.splitlines() if "PartitionFilters" in line]
    assert any("bucket" in line.split("PartitionFilters:")[1].split("]")[0] for line in scans)


def test_id_scan_reads_ids_only(spark, store, plan):
    store.ensure(2)
    store.upsert(points(spark, [(1, 1.0)]), replace=False)
    schema = plan(store.ids()).split("ReadSchema:")[1]
    assert "id:bigint" in schema and "vector" not in schema and "payload" not in schema


def test_article_store(spark, scratch, articles, plan):
    store = ArticleStore(spark, scratch("articles"), buckets=4)
    assert store.count() == 0
    first = articles.where("seq < 30")
    store.append(store.only_new(first, 30))
    store.append(store.only_new(articles, 40))
    assert store.count() == 40 and store.only_new(articles, 40).count() == 0
    found = store.lookup(articles.where("seq = 3").select("id"), 1)
    assert [r["link"] for r in found.collect()] == ["u3"]
    assert "dynamicpruning" in plan(found).lower()
    with pytest.raises(ValueError, match="4 buckets"):
        ArticleStore(spark, store.path, buckets=8)


def test_search_over_the_store(spark, scratch, articles, vectors):
    store = ArticleStore(spark, scratch("articles"), buckets=4)
    store.append(articles)
    queries = queries_of(spark, (1, "alpha beta"), (2, "gamma"))
    for scorer in ("lexical", "passthrough", Lengths):
        expected = semantic_search(queries, articles, vectors, model, scorer=scorer).collect()
        got = semantic_search(
            queries, store.read(), vectors, model, scorer=scorer, buckets=4
        ).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and got


# --- build ---


def test_build_modes(articles, store):
    some = articles.where("seq < 10")
    assert build_vectors(some, store, model, dim=DIM) == BuildReport(10, 0, 0)
    assert build_vectors(articles, store, model, dim=DIM, slices=3) == BuildReport(30, 0, 10)
    once = {r["id"]: r["vector"] for r in store.read().collect()}
    assert build_vectors(articles, store, model, dim=DIM).encoded == 0
    assert build_vectors(articles, store, model, FORCE, DIM) == BuildReport(40, 0, 40)
    assert {r["id"]: r["vector"] for r in store.read().collect()} == once
    assert build_vectors(some, store, model, RECREATE, DIM) == BuildReport(10, 0, 0)
    assert store.count() == 10
    with pytest.raises(ValueError, match="unknown mode"):
        build_vectors(articles, store, model, "other")


def test_empty_text_is_counted_and_embedded(raw_rows, store):
    articles = prepare_articles(raw_rows([{"link": "a"}, {"link": "b", "tieu_de": "x"}]))
    assert build_vectors(articles, store, model, dim=DIM) == BuildReport(2, 1, 0)


class Broken:
    def embed_batch(self, texts):
        if any("title 7" in t for t in texts):
            raise RuntimeError("model down")
        return model().embed_batch(texts)


def test_rerun_after_failure_completes(articles, store):
    with pytest.raises(Exception, match="model down"):
        build_vectors(articles, store, Broken, dim=DIM, slices=8)
    done = store.count()
    report = build_vectors(articles, store, model, dim=DIM)
    assert report.already_stored == done and report.encoded == 40 - done
    assert store.count() == 40


def test_slices_by_size_keep_all_but_the_last(articles, store, monkeypatch):
    """Without a number of slices the work at hand decides; what was done stays."""
    monkeypatch.setattr(building, "SLICE_ROWS", 10)
    last = [r["tieu_de"] for r in articles.where("pmod(id, 4) = 3").collect()]

    class Down:
        def embed_batch(self, texts):
            if any(t.split("\n")[0] in last for t in texts):
                raise RuntimeError("model down")
            return model().embed_batch(texts)

    with pytest.raises(Exception, match="model down"):
        build_vectors(articles, store, Down, dim=DIM)
    assert store.count() == 40 - len(last) > 0
    assert build_vectors(articles, store, model, dim=DIM).encoded == len(last)
    writes = len(store._commits())
    assert build_vectors(articles, store, model, dim=DIM) == BuildReport(0, 0, 40)
    assert len(store._commits()) == writes


# --- audit ---


def test_audit(spark, articles):
    ids = [r["id"] for r in articles.orderBy("seq").limit(30).collect()]
    rows = [(i, [1.0, 2.0]) for i in ids + [ids[0], 1, 2]] + [(3, [1.0])]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<float>")
    report = {r["metric"]: r["value"] for r in index_audit(articles, vectors, 2).collect()}
    assert report == {
        "articles": 40, "vectors": 34, "covered": 30, "pending": 10, "orphans": 3,
        "repeated_article_ids": 0, "repeated_vector_ids": 1, "empty_texts": 0,
        "wrong_dimension": 1,
    }
    assert pending_ids(articles, vectors).count() == 10
    assert {r["id"] for r in orphan_ids(vectors, articles).collect()} == {1, 2, 3}
    for bound in (None, 40):
        assert {r["seq"] for r in pending_articles(articles, vectors, bound).collect()} == set(range(30, 40))


# --- rerank ---


class Lengths:
    def score(self, query, passages):
        if query == "down":
            raise RuntimeError("down")
        if query == "short":
            return [1.0]
        if query == "nan":
            return [float("nan")] * len(passages)
        if query == "ties":
            return [{"score": 0.5}] * len(passages)
        return [[{"score": len(p)}] for p in passages]


def test_score_shapes():
    assert extract_score(2) == extract_score({"score": 2}) == extract_score([{"score": 2}]) == 2
    for bad in ({}, None, [], "x", float("nan")):
        assert score_or_none(type("S", (), {"score": lambda s, q, p: [bad]})(), "q", ["p"]) == [None]


@pytest.fixture
def hits(spark, articles):
    ids = [r["id"] for r in articles.orderBy("seq").limit(3).collect()]
    rows = [
        (q, i, 0.9 - n / 10, n + 1)
        for q in range(5)
        for n, i in enumerate([ids[0], 123, ids[1], ids[2]])
    ]
    return spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank int")


def test_fallback_is_per_query(spark, articles, hits):
    names = ["down", "short", "nan", "ties", "fine"]
    queries = queries_of(spark, *enumerate(names))
    ranked = rerank(hits, queries, articles, 20, 100, Lengths).collect()
    length = {r["id"]: len(r["summary"]) for r in articles.collect()}
    by_query = {}
    for r in sorted(ranked, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(names[r["query_id"]], []).append(r)
    first = [r["id"] for r in hits.where("query_id = 0 and id <> 123").orderBy("rank").collect()]
    for name in ("down", "short", "nan"):
        assert [r["id"] for r in by_query[name]] == first
        assert [round(r["score"], 6) for r in by_query[name]] == [0.9, 0.7, 0.6]
        assert [r["rank"] for r in by_query[name]] == [1, 2, 3]
    assert [r["id"] for r in by_query["ties"]] == first
    assert {r["score"] for r in by_query["ties"]} == {0.5}
    expected = sorted(first, key=lambda i: (-length[i], first.index(i)))
    assert [r["id"] for r in by_query["fine"]] == expected


@pytest.mark.parametrize("scorer", ["lexical", Lengths])
@pytest.mark.parametrize("hits_per_salt, broadcast_bytes", [(10_000, 1 << 26), (2, 0)])
def test_hot_articles_are_spread(
    spark, articles, monkeypatch, scorer, hits_per_salt, broadcast_bytes
):
    """One article wanted by every query; the plain scores come from Python."""
    monkeypatch.setattr(reranking, "MEMBERS_PER_SALT", hits_per_salt)
    for name in ("broadcast_if_bounded", "is_bounded"):
        limited = partial(getattr(bounds, name), limit=broadcast_bytes)
        monkeypatch.setattr(reranking, name, limited)
    by_id = {r["id"]: r["summary"] for r in articles.collect()}
    hot, *others = sorted(by_id)
    asked = {q: " ".join(WORDS[q % 8 : q % 8 + q % 4]) + ", Alpha none" for q in range(30)}
    asked |= {30: " ?", 31: None}
    rows = [(q, i, 0.5 - n / 10, n + 1) for q in asked for n, i in enumerate([hot, 5, others[q]])]
    hits = spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank int")
    ranked = rerank(hits, queries_of(spark, *asked.items()), articles, len(rows), 1000, scorer)
    got = {(r["query_id"], r["id"]): r["score"] for r in ranked.collect()}
    assert len(got) == 64
    if scorer != "lexical":
        return
    for (q, i), score in got.items():
        if asked[q] is None:
            assert score == {hot: 0.5, others[q]: 0.3}[i]
            continue
        words = set(asked[q].lower().replace(",", " ").replace("?", " ").split())
        share = len(words & set(by_id[i].split())) / len(words) if words else 0
        assert score == pytest.approx(1 / (1 + math.exp(-share)), abs=1e-6)


def test_passthrough_closes_the_holes_of_orphans(spark, articles, hits):
    queries = queries_of(spark, (0, "x"))
    ranked = rerank(hits.where("query_id = 0"), queries, articles, 20, 1, "passthrough")
    assert sorted(r["rank"] for r in ranked.collect()) == [1, 2, 3]


def test_passage(spark):
    rows = [("s", "t"), ("", "t"), (None, "t"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = [r[0] for r in df.select(passage(F.col("s"), F.col("t"))).collect()]
    assert got == ["s", "t", "t", "", ""]


def test_apply_scores_keeps_first_stage_order_on_ties(spark):
    rows = [(1, 10, 0.9, 1, 0.5), (1, 11, 0.8, 2, 0.5), (1, 12, 0.7, 3, 0.6)]
    df = spark.createDataFrame(rows, "query_id int, id int, score double, rank int, new_score double")
    got = {r["id"]: r["rank"] for r in apply_scores(df).collect()}
    assert got == {12: 1, 10: 2, 11: 3}


# --- search ---


@pytest.fixture
def vectors(articles, store):
    build_vectors(articles, store, model, dim=DIM)
    return store.read().persist()


def test_search(spark, articles, vectors):
    queries = queries_of(
        spark, (1, "alpha beta"), (2, "  "), (3, None), (4, " alpha beta\n"), (5, "zzz qqq")
    )
    found = semantic_search(
        queries, articles, vectors, model, top_k=3, candidate_k=6, threshold=0.5
    ).persist()
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r)
    assert set(rows) <= {1, 4, 5} and len(rows[1]) == 3
    assert [r["id"] for r in rows[1]] == [r["id"] for r in rows[4]]
    assert [r["rank"] for r in rows[1]] == [1, 2, 3]
    scores = [r["score"] for r in rows[1]]
    assert scores == sorted(scores, reverse=True)
    for r in rows[1]:
        assert r["content"] == "content " + r["title"].split()[1] and r["image"] is None
    items = as_list_items(found)
    assert items.where("author is null and comments is null").count() == found.count()
    pages = {r["query_id"]: r for r in list_envelopes(queries, found).collect()}
    assert len(pages) == 5
    assert (pages[1]["total"], pages[1]["limit"]) == (3, 3)
    assert (pages[2]["total"], pages[2]["limit"], pages[2]["query"]) == (0, 10, "  ")


def test_orphan_does_not_take_a_place(spark, articles, vectors):
    queries = queries_of(spark, (1, "alpha beta"))
    options = dict(top_k=5, candidate_k=6, threshold=None, scorer="passthrough")
    before = semantic_search(queries, articles, vectors, model, **options).orderBy("rank").collect()
    fewer = articles.where(F.col("id") != before[0]["id"])
    after = semantic_search(queries, fewer, vectors, model, **options).orderBy("rank").collect()
    assert [r["id"] for r in after][:4] == [r["id"] for r in before][1:]
    assert [r["rank"] for r in after] == [1, 2, 3, 4, 5]


def test_missing_content_is_null(spark, articles, vectors):
    queries = queries_of(spark, (1, "alpha beta"))
    content = articles.where("seq % 2 = 0").select("id", "noi_dung")
    found = semantic_search(
        queries, articles, vectors, model, content=content, threshold=None
    ).collect()
    assert len(found) == 10
    for r in found:
        assert (r["content"] is None) == (int(r["title"].split()[1]) % 2 == 1)


def test_all_blank(spark, articles, vectors):
    queries = queries_of(spark, (1, " "), (2, None))
    assert semantic_search(queries, articles, vectors, model).count() == 0


def test_search_through_cells(spark, articles, vectors):
    from functools import partial

    planes = knn.random_planes(4, DIM)
    search = partial(knn.knn_lsh, planes=planes, probes=16)
    queries = queries_of(spark, (1, "alpha beta"), (2, "gamma"))
    cells = knn.with_cell(vectors, planes).persist()
    exact = semantic_search(queries, articles, vectors, model).collect()
    same = semantic_search(queries, articles, cells, model, search=search).collect()
    assert sorted(map(tuple, exact)) == sorted(map(tuple, same))


def test_content_lookup_does_not_shuffle_content(spark, articles, scratch, plan):
    path = scratch("content")
    articles.select("id", "noi_dung").write.parquet(path)
    ids = articles.limit(5).select("id")
    found = lookup_content(spark.read.parquet(path), ids, 5)
    assert found.count() == 5 and "BroadcastHashJoin" in plan(found)


# --- hot keys ---


def test_salted_joins_equal_broadcast(spark):
    members = spark.range(1000).select(
        F.col("id").alias("query_id"), (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).cast("bigint").alias("rep_id")
    )
    sizes = members.groupBy("rep_id").agg(F.count("*").alias("n"))
    results = spark.range(100).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("x"))
    expected = sorted(map(tuple, members.join(results.withColumnRenamed("query_id", "rep_id"), "rep_id")
                          .select("query_id", "x").collect()))
    by_rep = results.withColumnRenamed("query_id", "rep_id")
    for limit in (0, 10**9):
        got = bounds.join_hot(members, by_rep, ["rep_id"], "query_id", 100, 16, limit)
        assert sorted(map(tuple, got.select("query_id", "x").collect())) == expected
    for per_salt in (10_000, 7):
        bounds.MEMBERS_PER_SALT, kept = per_salt, bounds.MEMBERS_PER_SALT
        try:
            got = bounds.expand_to_members(results, members.join(sizes, "rep_id"))
            assert sorted(map(tuple, got.select("query_id", "x").collect())) == expected
        finally:
            bounds.MEMBERS_PER_SALT = kept


def test_bounds():
    assert bounds.is_bounded(10, 10, 100) and not bounds.is_bounded(10, 11, 100)


# --- stream ---


def test_stream_equals_batch(spark, raw, scratch):
    drops, progress = scratch("drops"), scratch("progress")
    articles = ArticleStore(spark, scratch("articles"), buckets=4)
    vectors = VectorStore(spark, scratch("vectors"))

    def deliver(rows):
        rows.coalesce(1).write.mode("append").parquet(drops)
        stream = read_drops(spark, drops, raw.schema)
        start_ingest(stream, articles, vectors, model, progress, DIM).awaitTermination()

    deliver(raw.where("seq < 20"))
    deliver(raw.where("seq < 20"))  # the same again
    repost = raw.where("seq >= 15").withColumn("tieu_de", F.lit("repost"))
    deliver(repost)

    assert articles.count() == 40 and vectors.count() == 40
    titles = {r["link"]: r["tieu_de"] for r in articles.read().collect()}
    assert titles["u15"] == "title 15" and titles["u30"] == "repost"


def test_replay_completes_a_half_written_delivery(spark, raw, scratch):
    articles = ArticleStore(spark, scratch("articles"), buckets=4)
    vectors = VectorStore(spark, scratch("vectors"))
    with pytest.raises(Exception, match="model down"):
        ingest_batch(raw, articles, vectors, Broken, DIM)
    assert articles.count() == 40 and vectors.count() == 0
    for _ in range(2):
        ingest_batch(raw, articles, vectors, model, DIM)
        assert articles.count() == 40 and vectors.count() == 40


def test_drops_of_several_files(spark, monkeypatch):
    """Large drops are written by several tasks, with the same rows stored."""
    from gleaner.plans import workload

    monkeypatch.setattr(workload, "DROP_ROWS", 20)
    read = []
    drops = workload.read_drops
    monkeypatch.setattr(
        workload, "read_drops", lambda s, path, *a, **o: read.append(path) or drops(s, path, *a, **o)
    )
    sf_dir = "/root/testdata/sf0.001"
    got = {r["id"]: r["seq"] for r in workload.REGISTRY["stream_ingest"](spark, sf_dir).collect()}
    wanted = workload.Tables(spark, sf_dir).articles().select("id", "seq").collect()
    assert got == {r["id"]: r["seq"] for r in wanted}
    assert len(spark.read.parquet(read[0]).inputFiles()) > 6
