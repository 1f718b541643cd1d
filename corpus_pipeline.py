"""A corpus pipeline: each stage takes all documents that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidlens.llm import jaccard_join, packing, quality, secrets, suffix_dedup
from sidlens.llm.common import saved
from sidlens.llm.queries import vocabulary

#: Passages of over 50 words that repeat go, however short their words.
LEAST_WORDS = 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_quality(docs, net, score_column="_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard similarity 0.8 or more on five-word shingles hold together, the document of the least id."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings and of runs of LEAST_WORDS words that start anywhere else; those of which nothing is left go."""
    left = suffix_dedup.without_repeats(docs, least_words=LEAST_WORDS)
    return left.where(F.col("text").isNull() | (F.col("text") != ""))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secrets.redacted(docs, vocabulary("byte_bpe_50k.tiktoken"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_group),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage already has no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
