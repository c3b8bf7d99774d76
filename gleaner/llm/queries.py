"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    chat,
    collocations,
    decontaminate,
    filter_audit,
    html,
    ngram_lm,
    packing,
    repeats,
    sharding,
    simhash,
    toxicity,
    vptree,
    warc,
)
from gleaner.llm.oracle import ORACLE  # noqa: F401
from gleaner.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents left after strings of 400 bytes found twice are removed.

    The last column is what is left, as text.
    """
    docs = _table(spark, sf_dir, "documents")
    cut = repeats.remove_repeats(docs, ["doc_id"], 400, digest=True)
    return cut.withColumnRenamed("kept", "text")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those not held out."""
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of held-out rows are not learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, "doc_id").select(
        "doc_id",
        toxicity.is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def tokenizer_files() -> tuple[str, str]:
    """The 50k byte-level vocabulary as installed on every node, in both forms."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer_files())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, items)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract_main_text(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


PROBE_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    given = _table(spark, sf_dir, "conversations").select(*columns)
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    chats = chat.format_chats(given.unionByName(probe))
    read = chat.parse_chats(chats.select("conv_id", "formatted", "loss_spans"), keep=True)
    told = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op10_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    given = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector")
    )
    return vptree.nearest(given, F.col("vec_id") % 20 == 0, k=20)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, in all 120 orders."""
    return filter_audit.audit_filters(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations.mine_collocations(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    folder = scratch_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"
    )


REGISTRY = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_ngram_lm": op2_ngram_lm,
    "op3_toxicity": op3_toxicity,
    "op4_html_text": op4_html_text,
    "op5_pack": op5_pack,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_byte_shards": op8_byte_shards,
    "op9_simhash": op9_simhash,
    "op10_vptree": op10_vptree,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_warc": op13_warc,
}
