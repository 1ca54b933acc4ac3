"""A corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from heapspark.llm import common, lines, neardup, packing, quality, secrets


#: Chunks that a packing worker remembers, which other stages' tasks find in the workers that they share.
CHUNKS = 150_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    common.ship(spark)
    return quality.keep_good(docs)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text."""
    common.ship(spark)
    out = lines.drop_frequent_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least id."""
    common.ship(spark)
    return neardup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 2048 tokens."""
    common.ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memory=CHUNKS)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_frequent_lines),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: EM, MinHash, FDR control and byte-pair encoding have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
