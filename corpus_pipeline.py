"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmosaic.llm import contamination, lines, mixing, ngrams, quality
from gridmosaic.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents it is given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars is that of the new text, null for null text."""
    out = lines.drop_site_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return ngrams.one_of_each_group(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    docs = docs.select(*COLUMNS)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.drop_contaminated(docs, benchmark).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix),
]

# The classifier is trained here, so no SQL gives its rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
