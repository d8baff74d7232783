"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, langid, mixing, neardup, quality
from basalt.llm._text import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no text or letter, or no language with a posterior of a half."""
    return langid.keep(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")), least=0.5)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose quality scores under 0.3."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return neardup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat up to twice, so that their tempered weights hold; the
    budget is the smallest that shows every document at least once."""
    return mixing.mix(docs, mixing.word_tokens(), max_epochs=2.0).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the digest of their decoded text."""
    out = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe", encode),
]

#: Language ID, SimHash and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    place = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
