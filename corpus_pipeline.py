"""Corpus pipeline over ``documents``: quality, repeated lines, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of ``documents``; the last returns the mix: words taken of every document that is left.
NULL and empty texts are rejected by the first stage; an empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.llm.decontaminate import decontaminate
from prismcat.llm.lines import line_dedup
from prismcat.llm.mixing import mix
from prismcat.llm.quality import keep_quality
from prismcat.llm.simhash import near_dedup
from prismcat.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand elsewhere; documents of which nothing is left go."""
    return line_dedup(docs, drop_emptied=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixture),
]
# Trained models, XXH64 fingerprints and pseudorandom draws have no SQL form; the tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
