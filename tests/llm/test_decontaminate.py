import numpy as np

from gleaner.llm import decontaminate as dc
from gleaner.llm.queries import op6_decontaminate

DOCS = "doc_id bigint, text string, leaked boolean, item_id string"
ITEMS = "item_id bigint, text string"


def _items(random, n=40):
    words = [f"{a}{b}" for a in ("ter", "mol", "vin", "gas", "pel") for b in ("an", "or", "ik", "us", "em", "ol")]
    make = lambda k: " ".join(random.choice(words, k)).capitalize()
    items = [(i, f"{make(int(random.integers(8, 40)))}? {make(int(random.integers(6, 20)))}.") for i in range(n)]
    items += [(n, make(200) + "."), (n + 1, None), (n + 2, " \n"), (n + 3, "Oneword"), (None, items[0][1])]
    return words, items


def _brute(text, items):
    """Items whose question and answer shingles stand anywhere in one stretch of the text."""
    words = dc.words_of(text or "")
    found = set()
    for item_id, item in items:
        if not item or not dc.words_of(item):
            continue
        sides = dc.question_and_answer(item)
        reach = sum(map(len, sides))
        for at in range(0, max(len(words) - reach, 0) + 1):
            near = words[at : at + reach + reach // 8]
            ok = True
            for side in sides:
                wanted = dc.shingles_of(side)
                have = dc.shingles_of(near, min(dc.SHINGLE, len(side))) if len(near) >= min(dc.SHINGLE, len(side)) else set()
                ok &= not wanted or len(wanted & have) / len(wanted) >= dc.MIN_OVERLAP
            if ok:
                found.add(item_id)
                break
    return found


def _texts(random, words, items):
    texts = []
    for i in range(60):
        body = list(random.choice(words, int(random.integers(0, 300))))
        if i % 2:
            item = items[random.integers(len(items) - 5)][1].split()
            if i % 6 == 3:
                item[int(random.integers(len(item)))] = "changed"
            at = int(random.integers(len(body) + 1))
            body[at:at] = [w.upper() + "," if i % 4 == 1 else w for w in item]
        texts.append(" ".join(body))
    return texts + [None, "", items[40][1] + " tail", "oneword", "long " * 90_000 + items[5][1]]


def test_leaks_equal_brute_force(spark):
    random = np.random.default_rng(0)
    words, items = _items(random)
    texts = _texts(random, words, items)
    index = dc.ItemIndex([i for i in items if i[1]])
    for text in texts[:-1]:
        got = {index.items[i][0] for i in index.leaks(text or "")}
        assert got >= _brute(text, items)
        for i, figures in index.leaks(text or "").items():
            assert figures[0] >= dc.ENOUGH and min(figures[1:3]) >= dc.MIN_OVERLAP


def test_wand_finds_all_that_plain_scoring_finds():
    random = np.random.default_rng(1)
    words, items = _items(random, 150)
    index = dc.ItemIndex([i for i in items if i[1]])
    parts = len(index.item_of)
    for _ in range(60):
        terms = sorted({index.ids[w] for w in random.choice(words, 40) if w in index.ids})
        scores = np.zeros(parts)
        for t in terms:
            for p, x in zip(index.numbers[t], index.impacts[t], strict=True):
                scores[p] += x
        got = index.search(terms, 0, parts)
        assert set(got) == set(np.flatnonzero(scores >= dc.ENOUGH).tolist())
        assert all(abs(scores[p] - s) < 1e-9 for p, s in got.items())


def test_rows_are_found_and_dropped(spark):
    random = np.random.default_rng(2)
    words, items = _items(random)
    texts = _texts(random, words, items)
    rows = [(i, t, None, "clash") for i, t in enumerate(texts)] + [(None, items[3][1], True, "")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    found = dc.find_leaks(docs, bench).collect()
    dirty = {r.doc_id for r in found}
    assert None in dirty and len(texts) - 1 in dirty
    left = dc.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if i not in dirty]
    assert dc.without_leaks(docs, bench.limit(0)).count() == len(rows)
    assert dc.find_leaks(docs.limit(0), bench).count() == 0


def test_slices_of_the_benchmark_together(spark, monkeypatch):
    random = np.random.default_rng(3)
    words, items = _items(random)
    docs = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(_texts(random, words, items)[:30])], DOCS)
    bench = spark.createDataFrame(items, ITEMS)
    whole = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(dc, "SLICE_BYTES", 2000)
    assert len(list(dc.item_slices(bench))) > 2
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == whole


def test_query_finds_the_planted_items(spark, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in op6_decontaminate(spark, sf_dir).collect()}
    assert got >= planted and len(got - planted) <= 1
