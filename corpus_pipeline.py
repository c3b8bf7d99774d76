"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, packing, repeats, simhash, toxicity
from gleaner.llm.queries import tokenizer_files
from gleaner.llm.workers import free_name
from gleaner.session import scratch_path

#: Shorter than the operator's own 400: a passage of 50 words has about 250 bytes.
MIN_REPEAT_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity of text")
    scored = toxicity.score_toxicity(docs, model, *docs.columns, score=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Fingerprints of four-word shingles link at four or fewer differing bits.
    """
    return simhash.one_of_each_group(docs, simhash.near_duplicates(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that are found elsewhere as well."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    cut = repeats.remove_repeats(docs, others, MIN_REPEAT_BYTES)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 1024 tokens."""
    return packing.pack_documents(docs, *tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# No stage can be told in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
