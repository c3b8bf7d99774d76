"""The stages one after the other, on planted cases and on the given documents."""

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BAD = ["blargh", "snarkel", "grumfix", "zotter", "krelling"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    random = np.random.default_rng(11)
    words = [f"{a}{b}{c}" for a in "bcdfghklmnprst" for b in "aeiou" for c in ("rel", "mun", "tas", "vok", "dis", "ga")]
    prose = lambda k: " ".join(random.choice(words, k))
    passage, item = prose(70), f"{prose(20)}? {prose(12)}."
    texts = {i: prose(int(random.integers(60, 200))) for i in range(200)}
    for i in range(0, 60, 3):
        w = texts[i].split()
        for bad in random.choice(BAD, 4):
            w.insert(int(random.integers(len(w))), bad)
        texts[i] = " ".join(w)
    toxic = {i for i in range(0, 60, 3)}
    texts[301] = texts[101]
    near = texts[102].split()
    near[5] = "changed"
    texts[302] = " ".join(near)
    for i in (110, 111, 112):
        texts[i] = f"{texts[i]} {passage} {prose(20)}"
    texts[120] = f"{prose(30)} {item} {prose(30)}"
    texts[400], texts[401] = None, ""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts.items()] + [(150, texts[150], "en", "src0", 3)]
    rows += [(None, prose(90), None, None, None)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(190)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, passage


def _near_copies(rows):
    """Rows that go, comparing all fingerprints of four-word shingles with each other."""
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 4) for r in rows if r.doc_id is not None}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i, r in root.items() if i != r}


def test_each_stage_takes_out_what_it_should(spark, planted):
    folder, texts, toxic, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == names
        kept[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    assert set(texts) - set(ids["toxicity"]) == toxic
    gone = set(ids["toxicity"]) - set(ids["near_duplicates"])
    assert gone == _near_copies(kept["toxicity"]) and {301, 401} <= gone <= {301, 302, 401}
    assert ids["near_duplicates"].count(150) == 1 and None in ids["near_duplicates"]
    cut = {r.doc_id: r for r in kept["suffix_dedup"]}
    assert sorted(map(str, cut)) == sorted(map(str, ids["near_duplicates"]))
    for i, r in cut.items():
        if i in (110, 111, 112):
            assert passage[10:-10] not in r.text and 0 < len(r.text) < len(texts[i])
        elif i in (102, 302) and 302 not in gone:
            assert len(r.text) < len(texts[i])  # a near copy that the rule of four bits leaves
        elif i is not None:
            assert r.text == (texts[i] or "")
        assert r.n_chars == len(r.text)
    assert set(cut) - set(ids["decontamination"]) == {120}
    packed = kept["packing"]
    assert {r.doc_id for r in packed} == set(ids["decontamination"])


def test_run_equals_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and "sequence_id" in out.columns


def test_stages_take_an_empty_table(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
