"""Filters under all orders, against a plain simulation and a few given cases."""

import re
from collections import Counter
from itertools import permutations

import numpy as np

from gleaner.llm import filter_audit as fa

DOCS = "doc_id bigint, text string, lang string, mask int, n bigint, first string"
LABELS = "doc_id bigint, quality int, toxic int"


def test_ranks_are_lexicographic():
    for n in (1, 3, 5):
        for rank, order in enumerate(permutations(range(n))):
            assert fa.lehmer_rank(order, n) == rank
    assert fa.lehmer_rank((2,), 5) == 48 and fa.lehmer_rank((4, 3), 5) == 114


def _fails(text, smaller):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    tests = [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search("[#$%&*|]", text)),
        smaller,
    ]
    return {letter for letter, test in zip("ABCDE", tests) if test}


def _simulated(rows, labels):
    """Every order is run over every document."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        docs = [
            (i, _fails(t or "", i is not None and i > least[t or ""]))
            for i, t, lang in rows
            if (lang or "") == part
        ]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = sum(letter in f for _, f in docs)
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def _rows():
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "\x0b \x0c", "AB" * 80, "a|b", "# " * 120, "é" * 500]
    for _ in range(60):
        size, pool = int(random.integers(60, 160)), int(random.choice([40, 300]))
        words_of = random.choice(words[:pool], size).tolist() + ["$"] * int(random.integers(2))
        texts.append(random.choice([" ", "\t", "\x0c\n"]).join(words_of))
    texts += ["LOUD " * 120, "x y z " * 50000]
    ids = random.permutation(400)[: len(texts) * 3].tolist()
    rows = [(i, texts[k % len(texts)], ["en", "de", None, ""][k % 4]) for k, i in enumerate(ids)]
    return rows + rows[:5] + [(None, texts[9], "en"), (None, texts[0], "null ids"), (7000, texts[9], "en")]


def test_all_orders_against_simulation(spark):
    rows = _rows()
    labels = [(i, k % 2, (k // 2) % 2) for k, (i, *_) in enumerate(rows) if k % 3]
    labels += [labels[0], (labels[1][0], 1, 1), (None, 1, 1), (99999, 1, 1), (rows[5][0], None, None)]
    docs = spark.createDataFrame([(*r, 3, 4, "clash") for r in rows], DOCS)
    out = fa.audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in out}
    assert len(out) == len(got) == 600 * 4 and got == _simulated(rows, labels)


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "a", "en", 0, 0, "")], DOCS)
    out = fa.audit_filters(docs, labels).collect()
    assert len(out) == 600 and {r.removed for r in out} == {0, 1}
    assert sum(r.good_lost + r.toxic_lost for r in out) == 0
    assert {r.shapley for r in out if r.filter_order[r.step - 1] == "A"} == {120}
    assert fa.audit_filters(docs.limit(0), labels).count() == 0


def test_copies_of_a_text_meet_nowhere(spark, plan):
    """The join that finds repeats has the id in its key, so a hot text is spread."""
    docs = spark.createDataFrame([(i, "same", "en", 0, 0, "") for i in range(50)], DOCS)
    assert "digest" in plan(fa.masked_documents(docs)) and "doc_id" in plan(fa.masked_documents(docs))
    masks = Counter(r["mask"] for r in fa.masked_documents(docs).collect())
    assert masks == {1: 1, 17: 49}


def test_other_numbers_of_filters(spark):
    counts = [("p", 1, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 3, 1, 1, 0), ("p", 0, 4, 4, 0)]
    df = spark.createDataFrame(counts, "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in fa.order_totals(df, "XY").collect()}
    assert got == {
        ("XY", 1): (4, 8, 0, 13), ("XY", 2): (4, 0, 3, 3),
        ("YX", 1): (9, 3, 0, 3), ("YX", 2): (4, 5, 3, 13),
    }
