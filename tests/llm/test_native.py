"""Chat formatting and sharding: round trips, edges, plans without Python."""

import hashlib
import time
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import chat, sharding
from gleaner.llm.queries import op7_chat_format, op8_byte_shards

CHAT = "conv_id bigint, turn bigint, role string, text string, formatted string"
DOCS = "doc_id bigint, text string, shard string, size int"


def _read_back(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], CHAT)
    chats = chat.format_chats(df)
    read = chat.parse_chats(chats, keep=True).withColumn(
        "loss", chat.masked_texts(chats["formatted"], chats["loss_spans"])
    )
    return {r.conv_id: ([tuple(t) for t in r.turns], r.loss, r.formatted) for r in read.collect()}


def test_turns_survive_any_text(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "<|im_sep|>", "\\<\\[", "<\\", "", "\n", "é<", "["]
    rows = [(i, t, "assistant" if t % 2 else "user\n<|x", text) for i in range(3) for t, text in enumerate(nasty)]
    for conv, (turns, loss, formatted) in _read_back(spark, rows).items():
        assert [t for _, t in turns] == nasty and turns[0][0] == "user\n<|x"
        assert loss == nasty[1::2] and formatted.count("[INST]") == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("<[\\|/s>\na", max_size=12)), min_size=1, max_size=8))
def test_random_conversations_are_reversible(spark, turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    read, loss, _ = _read_back(spark, rows)[1]
    assert read == turns and loss == [t for r, t in turns if r == "assistant"]


def test_merging_order_and_nulls(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, None, "user", "last"),
        (2, 1, None, None), (2, 1, None, None), (None, 1, "user", "x"),
    ]
    out = _read_back(spark, rows)
    assert out[1][0] == [("user", "a"), ("assistant", "b"), ("assistant", "c"), ("user", "last")]
    assert out[1][2].count(chat.START) == 3 and out[1][2].count(chat.SEP) == 1
    assert out[2][0] == [("", ""), ("", "")] and out[None][0] == [("user", "x")]
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_many_turns_take_linear_time(spark):
    def rows(n):
        return [(c, t, "assistant" if t % 2 else "user", f"turn {t} <of> [{c}] \\") for c in range(2) for t in range(n)]

    assert _read_back(spark, rows(3))[0][1] == ["turn 1 <of> [0] \\"]  # warm
    begin = time.monotonic()
    out = _read_back(spark, rows(16_000))
    assert time.monotonic() - begin < 30  # minutes, were every span cut from the start
    for c, (turns, loss, _) in out.items():
        assert turns == [(r, t) for k, _, r, t in rows(16_000) if k == c] and loss == [t for r, t in turns if r == "assistant"]


def test_query_digests(spark, sf_dir="/root/testdata/sf0.001"):
    given_rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    convs = defaultdict(list)
    for r in sorted(given_rows, key=lambda r: (r.conv_id, r.turn)):
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in op7_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(turns), len(loss))
        assert row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_native_plans(spark, plan, sf_dir="/root/testdata/sf0.001"):
    for query in (op7_chat_format, op8_byte_shards):
        text = plan(query(spark, sf_dir))
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_shards_are_balanced_contiguous_and_gapless(spark):
    rows = [(i, "copy" if i % 3 == 0 else "é" * (i % 50), "x", 1) for i in range(3000)]
    rows += [(None, None, "x", 1)] * 3 + [(7, "long " * 2000, "x", 1)] + [(5, "same", "x", 1)] * 4
    out = sharding.assign_shards(spark.createDataFrame(rows, DOCS), 24).collect()
    assert len(out) == len(rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out)
    text = {i: t for i, t, *_ in rows if i is not None}
    for r in out:
        data = (text.get(r.doc_id) or "").encode()
        if r.doc_id not in (5, 7):
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert sharding.assign_shards(spark.createDataFrame([], DOCS), 24).count() == 0
    one = sharding.assign_shards(spark.createDataFrame(rows[:1], DOCS), 24).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
