import pytest
from pyspark.sql import functions as F

from gleaner.operators import listing
from gleaner.operators.keyword_batch import keyword_batch, keyword_pages, keyword_totals
from gleaner.operators.paging import Page, slice_page
from gleaner.operators.prepare import dedupe_report, prepare_articles, rejected_urls
from gleaner.schemas import require_columns
from gleaner.sources.csv import read_articles_csv, write_articles_csv
from gleaner.sources.jdbc import articles_from_news, jdbc_options, require_rows
from gleaner.sources.json_rows import to_json_rows, write_json


def url(n):
    return f"https://news.example/{n}"


@pytest.fixture
def articles(raw_rows):
    dates = ["2024-03-05", None, "2024-12-01", "2024-03-05", "2023-01-01"]
    rows = [
        {
            "link": url(n), "tieu_de": f"Tin {n}", "summary": "Đồng tiền",
            "ngay_dang": dates[n % 5], "so_binh_luan": str(n % 7) if n % 4 else None,
            "nguon": ["a", "b", None][n % 3],
        }
        for n in range(25)
    ]
    return prepare_articles(raw_rows(rows)).persist()


def test_missing_columns_are_listed(spark):
    with pytest.raises(ValueError, match="tac_gia"):
        require_columns(spark.createDataFrame([(1, "x")], "seq bigint, link string"))


def test_keep_first_and_rejects(raw_rows):
    raw = raw_rows(
        [
            {"link": url(1), "tieu_de": "first"},
            {"link": f" {url(1)}\n", "tieu_de": "again"},
            {"link": None}, {"link": " \t "}, {"link": ""},
            {"link": url(2), "seq": 9, "tieu_de": "late"},
            {"link": url(2), "seq": 8, "tieu_de": "early"},
        ]
    )
    kept = {r["tieu_de"] for r in prepare_articles(raw).collect()}
    assert kept == {"first", "early"}
    assert rejected_urls(raw).count() == 3
    assert dedupe_report(raw).first().asDict() == {
        "total_rows": 7, "rejected_rows": 3, "kept_rows": 2, "dropped_rows": 2,
    }


def test_report_of_nothing(raw_rows):
    assert dedupe_report(raw_rows([])).first()["total_rows"] == 0


def test_repeats_are_dropped_before_the_shuffle(raw_rows, plan):
    text = plan(prepare_articles(raw_rows([{"link": url(1)}])))
    before = text.split("Exchange hashpartitioning(url_key", 1)
    assert "WindowGroupLimit" in before[0] and "WindowGroupLimit" in before[1]


def test_id_filter_reaches_below_the_shuffle(spark, raw_rows, scratch, plan):
    path = scratch("raw")
    raw_rows([{"link": url(1)}]).write.parquet(path)
    text = plan(prepare_articles(spark.read.parquet(path)).where("id = 7"))
    assert "sha2" in text.split("Exchange", 1)[1]


def test_content_is_not_read_for_listing(spark, raw_rows, scratch, plan):
    path = scratch("raw")
    raw_rows([{"link": url(1)}]).write.parquet(path)
    articles = prepare_articles(spark.read.parquet(path))
    assert "noi_dung" not in plan(listing.news_items(articles)).split("ReadSchema")[1]


def test_hot_url(spark):
    """A third of all rows share one URL."""
    rows = spark.range(30_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit(url("hot")))
        .otherwise(F.concat(F.lit(url("")), F.col("id"))).alias("link"),
        *[F.lit("x").alias(c) for c in ["tieu_de", "summary", "nguon", "tac_gia",
                                        "ngay_dang", "so_binh_luan", "noi_dung"]],
    )
    kept = prepare_articles(rows)
    assert kept.count() == 20_001
    assert kept.where(F.col("link") == url("hot")).first()["seq"] == 0


@pytest.mark.parametrize("top_k_rows", [100_000, 0])
def test_pages_partition_the_list(articles, top_k_rows):
    order = [F.desc_nulls_last("publish_date"), F.asc("id")]
    items = listing.news_items(articles, "seq")
    expected = [r["id"] for r in items.orderBy(*order).collect()]
    seen = []
    for page in range(1, 6):
        rows = slice_page(items, "publish_date", order, Page.clamp(page, 7), top_k_rows)
        rows = rows.collect()
        assert [r["position"] for r in rows] == list(range(len(rows)))
        seen += [r["id"] for r in rows]
    assert seen == expected


def test_clamping():
    assert Page.clamp(0, 0) == Page(1, 1)
    assert Page.clamp(-5, 1000) == Page(1, 100)
    assert Page.clamp(3, 10).start == 20


def test_latest_featured_and_past_end(articles):
    latest = listing.latest_news(articles, limit=100).collect()
    dates = [r["publish_date"] for r in latest]
    assert dates[:5] == ["2024-12-01"] * 5 and dates[-5:] == [None] * 5
    comments = [r["comments"] for r in listing.featured_news(articles).collect()]
    assert comments == sorted(comments, reverse=True) and len(comments) == 5
    assert listing.latest_news(articles, page=999).collect() == []
    assert listing.latest_envelope(articles, page=999).first().asDict() == {
        "total": 25, "page": 999, "limit": 10, "total_pages": 3,
    }
    empty = articles.where("false")
    assert listing.latest_envelope(empty).first()["total_pages"] == 1
    assert listing.featured_envelope(articles).first()["total_pages"] == 5


def test_categories(articles):
    rows = [tuple(r) for r in listing.categories(articles).collect()]
    assert rows == [("a", 9), ("Khác", 8), ("b", 8)]
    assert listing.category_total(articles).first()["total"] == 3
    doc = listing.category_document(articles).first()
    assert doc["total"] == 3 and [e["name"] for e in doc["items"]] == ["a", "Khác", "b"]


def test_keyword_search(articles):
    found = lambda q: listing.keyword_matches(articles, q).count()
    assert found("dong") == 0
    assert found("ĐÔNG") == 25
    assert found(" tin 2 ") == 6
    assert found("2 đồng") == 3  # spans title and summary
    assert found(".") == 0
    assert found("") == found("   ") == found("\u0301") == 0
    page = listing.keyword_search(articles, "tin", page=2, limit=10).collect()
    assert [r["title"] for r in page] == [f"Tin {n}" for n in range(10, 20)]
    envelope = listing.keyword_envelope(articles, " TIN ", page=2).first()
    assert (envelope["query"], envelope["total"]) == (" TIN ", 25)


# Parts of words, whole words, several blanks, marks only, texts across title and summary.
ASKED = [
    "tin 2", "Tin 2 ", "ĐỒNG", "dong", "", "n 1", "tin 13", "ti", "t", "in 2 đ", "tin 2 đồng",
    "tin  2", "2", "tin 999 đồng", "\u0301 \u0301", "a\u0301 \u0301", "  ", "1 đồng", "ồn",
]


def _asked(spark, texts=ASKED):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def _singly(articles, texts=ASKED):
    return {
        (nth, r["id"], r["seq"])
        for nth, text in enumerate(texts)
        for r in listing.keyword_matches(articles, text).collect()
    }


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_keyword_batch_equals_single(spark, articles, broadcast_bytes):
    found = keyword_batch(articles, _asked(spark), broadcast_bytes).collect()
    assert {tuple(r) for r in found} == _singly(articles) and len(found) == len(set(found))
    totals = keyword_totals(articles, _asked(spark), broadcast_bytes).collect()
    expected = {}
    for nth, _, seq in _singly(articles):
        n, first = expected.get(nth, (0, seq))
        expected[nth] = (n + 1, min(first, seq))
    assert {r["query_id"]: (r["total"], r["first_seq"]) for r in totals} == expected


def test_keyword_batch_on_odd_texts(spark, raw_rows):
    titles = ["a b", "ab", "b  a", " a", "b ", "", None, "aa b a", "x\ty z", "é a", "a.b c"]
    rows = [{"link": f"u{n}", "tieu_de": t, "summary": s} for n, (t, s) in
            enumerate((t, s) for t in titles for s in (None, "", "a", "b a b", "z x\ty"))]
    articles = prepare_articles(raw_rows(rows)).persist()
    texts = ["a", "b", "ab", "a b", "b a", "a  b", "b  a", "a b a", "a a b", "x\ty", "y z x",
             "a  ", "e a", "b a b", "  b", "zz", "a.b", ".b c a"]
    for limit in (1 << 20, 0):
        found = keyword_batch(articles, _asked(spark, texts), limit).collect()
        assert {tuple(r) for r in found} == _singly(articles, texts)


def test_keyword_pages_equal_single_searches(spark, articles):
    for page, limit, size in ((1, 10, 1 << 20), (2, 4, 0), (9, 3, 1 << 20), (0, 500, 1 << 20)):
        got = keyword_pages(articles, _asked(spark), page, limit, size).collect()
        for nth, text in enumerate(ASKED):
            rows = sorted((r for r in got if r["query_id"] == nth), key=lambda r: r["position"] or 0)
            envelope = listing.keyword_envelope(articles, text, page, limit).first()
            items = listing.keyword_search(articles, text, page, limit).collect()
            assert {tuple(r)[:6] for r in rows} == {(nth, *envelope)}
            assert [r["id"] for r in rows if r["position"] is not None] == [r["id"] for r in items]
            assert len(rows) == max(1, len(items))


def test_keyword_batch_plan(spark, articles, plan):
    """Matching is a join on words in the JVM: no Python, and no pairs but through a key."""
    for limit, join in ((1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        text = plan(keyword_batch(articles, _asked(spark), limit))
        assert join in text and "Python" not in text and "Arrow" not in text
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_matches_of_broadcast_queries_are_not_shuffled(spark, raw_rows, plan):
    titles = ["ab cab ab xab", "xab ab", "cab abab", "c", "éab  ab"]
    rows = [{"link": f"u{n}", "tieu_de": t, "summary": "bab"[: n % 4]} for n, t in enumerate(titles)]
    articles, asked = prepare_articles(raw_rows(rows)).persist(), _asked(spark, ["ab", "b a", "ab "])
    found = keyword_batch(articles, asked)
    assert "hashpartitioning(rep_id" not in plan(found)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == _singly(articles, ["ab", "b a", "ab "])
    told = {(r["query_id"], r["total"]) for r in keyword_totals(articles, asked).collect()}
    assert told == {(q, sum(g[0] == q for g in got)) for q in {g[0] for g in got}}


def test_parts_of_many_words_stay_broadcast(spark, raw_rows, plan):
    """What is joined is as large as the queries, not as the words that contain them."""
    rows = [{"link": f"u{n}", "tieu_de": f"abc{n} bcd{n}", "summary": f"cab{n}a"} for n in range(300)]
    articles, texts = prepare_articles(raw_rows(rows)).persist(), ["a", "b", "c", "bc", "a b"]
    found = keyword_batch(articles, _asked(spark, texts), 1000)
    assert "salt" not in plan(found) and "BroadcastHashJoin" in plan(found)
    assert {tuple(r) for r in found.collect()} == _singly(articles, texts)


def test_keyword_batch_with_marks_of_many_grams(spark, articles, monkeypatch):
    monkeypatch.setattr("gleaner.operators.keyword_batch.LISTED", 2)
    for limit in (1 << 20, 0):
        found = [tuple(r) for r in keyword_batch(articles, _asked(spark), limit).collect()]
        assert set(found) == _singly(articles) and len(found) == len(set(found))


def test_scripts_are_looked_up_in_articles_prepared_once(spark, plan):
    from gleaner.plans.workload import REGISTRY

    text = plan(REGISTRY["keyword_scripts"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in text and "search_blob" in text


def test_keyword_batch_without_queries(spark, articles):
    blank = _asked(spark, [" "])
    assert keyword_batch(articles, blank).count() == keyword_totals(articles, blank).count() == 0
    assert [tuple(r)[:7] for r in keyword_pages(articles, blank).collect()] == [(0, " ", 0, 1, 10, 1, None)]
    assert keyword_pages(articles, blank.limit(0)).count() == 0
    none = keyword_pages(articles.where("false"), _asked(spark, ["t"])).collect()
    assert [tuple(r)[:7] for r in none] == [(0, "t", 0, 1, 10, 1, None)]


def test_page_document_and_json(spark, articles, scratch):
    doc = listing.page_document(
        listing.latest_news(articles, page=2), listing.latest_envelope(articles, page=2)
    ).first()
    ids = [r["id"] for r in listing.latest_news(articles, page=2).collect()]
    assert [item["id"] for item in doc["items"]] == ids and doc["total"] == 25
    items = listing.latest_news(articles).drop("position")
    first = to_json_rows(items, id_as_string=True).first()["json"]
    assert '"image":null' in first and f'"id":"{items.first()["id"]}"' in first
    path = scratch("json")
    write_json(items, path)
    assert spark.read.text(path).count() == 10


def test_display(spark):
    rows = [("2024-03-05", None, None), ("abc", "x", "t"), (None, "y", "u")]
    items = spark.createDataFrame(rows, "publish_date string, author string, title string")
    assert [tuple(r) for r in listing.display_items(items).collect()] == [
        ("05/03/2024", "Ẩn danh", "Không có tiêu đề"), ("abc", "x", "t"), ("", "y", "u"),
    ]


def test_csv_round_trip(spark, raw_rows, scratch):
    rows = [
        {"link": url(1), "tieu_de": 'say "hi", ok', "summary": "two\nlines", "nguon": "N/A",
         "noi_dung": "c:\\path\\"},
        {"link": url(2), "tieu_de": "  padded ", "summary": "null", "so_binh_luan": "2.5"},
    ]
    path = scratch("csv")
    write_articles_csv(raw_rows(rows).coalesce(1).drop("seq").select(
        "nguon", "tieu_de", "ngay_dang", "tac_gia", "summary", "so_binh_luan", "link", "noi_dung"
    ), path)
    got = {r["link"]: r for r in read_articles_csv(spark, path).orderBy("seq").collect()}
    first, second = got[url(1)], got[url(2)]
    assert first["tieu_de"] == 'say "hi", ok' and first["summary"] == "two\nlines"
    assert first["nguon"] is None and first["noi_dung"] == "c:\\path\\"
    assert second["tieu_de"] == "  padded " and second["summary"] is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_articles_csv(spark, scratch("missing"))


def test_news_table_mapping(spark):
    import datetime

    news = spark.createDataFrame(
        [(3, "s", "t", datetime.date(2024, 3, 5), "a", "sum", 4.0, url(1), "text")],
        "id int, source string, title string, publish_date date, author string, "
        "summary string, comments double, url string, content string",
    )
    rows = articles_from_news(news)
    assert "content" not in rows.columns
    assert rows.first()["ngay_dang"] == "2024-03-05" and rows.first()["seq"] == 3
    with pytest.raises(RuntimeError, match="no rows"):
        require_rows(rows.where("false"))


def test_jdbc_options():
    options = jdbc_options("jdbc:x", 1, 1000, 8, driver="d")
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert options["driver"] == "d" and options["dbtable"] == "news"

def test_content_of_any_number_of_urls(spark):
    from gleaner.sources.jdbc import content_of

    table = spark.range(1500).selectExpr("concat('u', id) AS url", "concat('c', id) AS content")
    got = content_of(table, [f"u{i}" for i in range(1001)] + ["u3", "missing"]).collect()
    assert sorted(r.url for r in got) == sorted(f"u{i}" for i in range(1001))
    assert content_of(table, []).count() == 0


def test_csv_order_follows_file_names(spark, scratch):
    import os

    from gleaner.sources.csv import read_articles_csv

    path = scratch("csv").removeprefix("file://")
    os.makedirs(path)
    names = "nguon,tieu_de,ngay_dang,tac_gia,summary,so_binh_luan,link,noi_dung"
    for n, rows in ((1, 3), (2, 400), (3, 20)):
        with open(f"{path}/part-{n}.csv", "w") as f:
            f.write(names + "\n")
            f.writelines(f"s,file {n} row {i:03},2024-01-01,a,b,1,http://x/{i},c\n" for i in range(rows))
    read = read_articles_csv(spark, path).orderBy("seq").select("tieu_de").collect()
    assert [r.tieu_de for r in read] == sorted(r.tieu_de for r in read) and len(read) == 423
