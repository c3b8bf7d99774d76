import zlib

import numpy as np

from gleaner.llm import toxicity
from gleaner.llm.queries import op3_toxicity

DOCS = "doc_id bigint, text string, score string, toxic int"
LABELS = "doc_id bigint, quality int, toxic int"


def _corpus(random, n=400):
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("rel", "mun", "tas", "vok", "dis")]
    bad = ["blargh", "snarkel", "grumfix", "zotter", "krelling"]
    rows, labels = [], []
    for i in range(n):
        text = list(random.choice(words, int(random.integers(5, 80))))
        toxic = i % 5 == 0
        if toxic:
            for w in random.choice(bad, int(random.integers(2, 5))):
                text.insert(int(random.integers(len(text))), w + random.choice(["", ".", "!"]))
        rows.append((i, " ".join(text), "clash", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_unseen_documents_are_told_apart(spark):
    rows, labels = _corpus(np.random.default_rng(0))
    rows += [(None, None, "", 0), (1000, "", "", 0), (1001, "ok " * 50_000, "", 0), (0, rows[0][1], "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], LABELS))
    got = toxicity.score_toxicity(docs, model, "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 1000 and (r.score >= 0.5) != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 4
    assert all(r.score < 0.5 for r in got if r.doc_id is None or r.doc_id >= 1000)


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = _corpus(np.random.default_rng(1), 200)
    docs = spark.createDataFrame(rows, DOCS)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    a, b = (
        toxicity.mine_lexicon(docs, spark.createDataFrame(x, LABELS)) for x in (labels, flipped)
    )
    assert a == b


def test_label_model_finds_rates_and_correlated_voters():
    random = np.random.default_rng(2)
    n, on_toxic, on_clean = 60_000, [0.6, 0.5, 0.7, 0.4, 0.3, 0.5], [0.02, 0.05, 0.01, 0.1, 0.3, 0.02]
    y = random.random(n) < 0.2
    votes = np.where(y[:, None], random.random((n, 6)) < on_toxic, random.random((n, 6)) < on_clean)
    votes = np.column_stack([votes, votes[:, 0] ^ (random.random(n) < 0.01)]).astype(float)
    both = votes.T @ votes
    model = toxicity.fit_label_model(n, np.diag(both).copy(), both, 0.2)
    assert np.allclose(model.on_toxic[1:6], on_toxic[1:], atol=0.1)
    assert np.allclose(model.on_clean[1:6], on_clean[1:], atol=0.05)
    assert (0, 6) in model.correlated and model.share[0] < model.share[1]
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.9
    assert model.accuracy[2] > model.accuracy[4]


def test_copies_of_a_toxic_text_make_no_lexicon(spark):
    rows, labels = _corpus(np.random.default_rng(3))
    copies = [(2000 + i, "quibbel wonzer fendle mipso " + rows[0][1], "", 0) for i in range(60)]
    labels += [(r[0], 1, 1) for r in copies]
    terms, _ = toxicity.mine_lexicon(spark.createDataFrame(rows + copies, DOCS), spark.createDataFrame(labels, LABELS))
    assert "blargh" in terms and "wonzer" not in terms


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text", "", 0), (2, None, "", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    model = toxicity.fit_toxicity(docs, none)
    assert {r.score < 0.5 for r in toxicity.score_toxicity(docs, model, "doc_id").collect()} == {True}
    empty = docs.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none), "doc_id").count() == 0


def test_query_shape(spark):
    out = op3_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 200
