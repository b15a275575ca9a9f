"""The corpus pipeline: five stages over ``documents``.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the
last returns token ids. A stage that reads its measures more than once writes them to the
shared scratch folder itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit.llm import bpe, fertility, minhash, pii, winnow
from crawlkit.llm.common import hex_digest, table, written
from crawlkit.llm.queries import FERTILITY, PII_KEY, WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the fertility bands accept."""
    measured = written(fertility.measure(docs, *FERTILITY), "measured")
    return fertility.judge(measured).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return minhash.near_duplicates(docs).where("first").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    checked = winnow.contamination(docs, table(spark, sf_dir, "benchmark"))
    return checked.where("not contaminated").select(*docs.columns)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; ``n_chars`` follows the new text."""
    new = pii.pseudonymize(docs, PII_KEY).select(*docs.columns)
    return new.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else new


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of ids and decoded text."""
    both = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE)
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        hex_digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonymize),
    ("tokens", tokenize),
]

#: SQL has no vocabularies, MinHash or keyed permutations; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
