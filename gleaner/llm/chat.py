"""Chat formatting with Spark expressions: one string and loss mask per conversation.

A conversation becomes blocks ``<|im_start|>role\\n text <|im_end|>\\n``. Adjacent turns
of one role share a block, their texts set apart by ``<|im_sep|>``. Inside roles and
texts every backslash is doubled, then every ``<`` and ``[`` is followed by a backslash,
so none of ``<|...|>``, ``</s>``, ``[INST]`` can occur there; undoing it in the opposite
order restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
NEWLINE_IN_ROLE = "<|nl|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.replace(doubled, F.lit("<"), F.lit("<\\"))
    return F.replace(angled, F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    squared = F.replace(text, F.lit("[\\"), F.lit("["))
    angled = F.replace(squared, F.lit("<\\"), F.lit("<"))
    return F.replace(angled, F.lit("\\\\"), F.lit("\\"))


def _quoted(marker: str) -> str:
    return "\\Q" + marker + "\\E"


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows (conv_id, turn, role, text).

    ``loss_spans`` are (start, length) in code points of ``formatted``, one for each
    assistant text, none for the markers between them. Null texts and roles are empty;
    rows without a turn number come last; equal numbers are ordered by role and text,
    and repeated rows all stay. A null conv_id is a conversation of its own. No rows
    give no conversations. Other columns are ignored.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(
        F.col("turn").isNull().alias("unnumbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )

    def piece(t: Column, i: Column) -> Column:
        # try_element_at counts from 1: i is the turn before, i + 2 the one after.
        before = F.when(i > 0, F.try_element_at("turns", i)["role"])
        after = F.try_element_at("turns", i + 2)["role"]
        opening = F.concat(
            F.lit(START),
            F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE_IN_ROLE)),
            F.lit("\n"),
        )
        return F.struct(
            F.when(before.eqNullSafe(t["role"]), F.lit(SEP)).otherwise(opening).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
            (t["role"] == ASSISTANT).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def sizes(p: Column) -> Column:
        body = F.length(p["body"]).cast("long")
        return F.struct(
            F.length(p["head"]).cast("long").alias("head"),
            body.alias("body"),
            (F.length(p["head"]) + body + F.length(p["tail"])).alias("whole"),
            p["loss"].alias("loss"),
        )

    whole = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"]))
    sized = pieces.select(
        "conv_id", F.array_join(whole, "").alias("formatted"), F.transform("pieces", sizes).alias("sizes")
    )
    # Positions run over pieces within short runs, and over runs by their totals: neither
    # the growing list of spans nor the sum is copied or taken again for every piece.
    in_runs = sized.select("conv_id", "formatted", _runs(F.col("sizes")).alias("runs"))
    total = F.transform("runs", lambda r: F.aggregate(r, _zero(), lambda s, p: s + p["whole"]))
    totals = in_runs.select("*", total.alias("totals"))

    def step(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        return F.struct(
            (state["at"] + p["whole"]).alias("at"),
            F.when(p["loss"], F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    def spans(run: Column, number: Column) -> Column:
        before = F.aggregate(F.slice("totals", 1, number), _zero(), lambda s, t: s + t)
        none = F.array().cast("array<struct<start:bigint,length:bigint>>")
        return F.aggregate(run, F.struct(before.alias("at"), none.alias("spans")), step)["spans"]

    return totals.select(
        "conv_id", "formatted", F.flatten(F.transform("runs", spans)).alias("loss_spans")
    )


def _zero() -> Column:
    return F.lit(0).cast("long")


def _runs(array: Column) -> Column:
    """The array in about as many runs as a run has elements; no runs if it is empty."""
    size = F.size(array)
    width = F.ceil(F.sqrt(size)).cast("int")
    last = F.floor((size - 1) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(array, c * width + 1, width))
    return F.when(size > 0, cut).otherwise(F.slice(F.array(array), 1, 0))


def parse_chats(chats: DataFrame, keep: bool = False) -> DataFrame:
    """``conv_id, turns array<struct<role, text>>``, read back from ``formatted`` alone.

    ``keep`` adds the turns to the columns at hand.
    """

    def block(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        texts = F.split(F.substring(b, F.length(role) + 2, F.length(b)), _quoted(SEP), -1)
        plain = unescape(F.replace(role, F.lit(NEWLINE_IN_ROLE), F.lit("\n")))
        return F.transform(
            texts, lambda t: F.struct(plain.alias("role"), unescape(t).alias("text"))
        )

    blocks = F.split("formatted", _quoted(END), -1)
    # What follows the last end mark is empty.
    full = F.slice(blocks, 1, F.size(blocks) - 1)
    bare = F.transform(full, lambda b: F.substring(b, len(START) + 1, F.length(b)))
    columns = ["*"] if keep else ["conv_id"]
    return chats.select(*columns, F.flatten(F.transform(bare, block)).alias("turns"))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask.

    Each run of spans is cut from the string at once, and its texts from that cut.
    """

    def cut(run: Column) -> Column:
        first, last = F.element_at(run, 1)["start"], F.element_at(run, -1)
        size = last["start"] + last["length"] - first
        part = F.substring(formatted, (first + 1).cast("int"), size.cast("int"))
        return F.struct(first.alias("first"), part.alias("part"), run.alias("run"))

    def texts(c: Column) -> Column:
        return F.transform(
            c["run"],
            lambda s: unescape(
                F.substring(
                    c["part"], (s["start"] - c["first"] + 1).cast("int"), s["length"].cast("int")
                )
            ),
        )

    return F.flatten(F.transform(F.transform(_runs(spans), cut), texts))
