import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import packing
from gleaner.llm.queries import tokenizer_files
from gleaner.llm.tokens import ByteBpe

LATIN = st.characters(min_codepoint=1, max_codepoint=0x24F)


@pytest.fixture(scope="module")
def encoders():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return ByteBpe(*tokenizer_files()), plain


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(LATIN, max_size=60), st.text(max_size=30), st.text("<|endoftx> \n\t\xa0", max_size=40)))
def test_ids_equal_the_tokenizer(encoders, text):
    fast, plain = encoders
    assert fast.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_tightest_window_is_found():
    tree = packing.CapacityTree(1024)
    free = [3, 1024, 700, 512, 700]
    for w, f in enumerate(free):
        tree.add(f, w)
    random = np.random.default_rng(3)
    while free:
        length = int(random.integers(1, 1025))
        best = min((f for f in free if f >= length), default=None)
        w = tree.take(length)
        if best is None:
            assert w is None
            break
        assert tree.windows is not None and best == [3, 1024, 700, 512, 700][w]
        free.remove(best)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_equals_a_plain_search(lengths):
    windows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = [(100 - sum(lengths[j] for j in w), n) for n, w in enumerate(windows)]
        room = [r for r in room if r[0] >= lengths[i]]
        if room:
            windows[min(room)[1]].append(i)
        else:
            windows.append([i])
    got = packing.best_fit(lengths, 100)
    assert len(got) == len(windows)
    filled = packing.fill_gaps([[(i, 0, lengths[i]) for i in w] for w in got], 100, 5)
    pieces = sorted((i, a, b) for w in filled for i, a, b in w)
    assert sum(b - a for _, a, b in pieces) == sum(lengths) and len(filled) <= len(got)
    assert all(sum(b - a for _, a, b in w) <= 100 for w in filled)


def test_pieces_tile_documents_and_windows(spark, encoders):
    fast, _ = encoders
    texts = ["word " * n for n in (0, 1, 5, 300, 1023, 1024, 5000)] + [None, "é" * 70, "same", "same"]
    rows = [(i if i != 4 else None, t, 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offset double")
    out = packing.pack_documents(df, *tokenizer_files(), capacity=256).collect()
    ids = {i: np.append(fast.encode(t or ""), 0).astype("<u4") for i, t, _ in rows}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for of, total in ((pieces, None), (windows, 256)):
        for key, spans in of.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == len(ids[key]) if total is None else at <= total
    assert packing.pack_documents(df.limit(0), *tokenizer_files()).count() == 0
