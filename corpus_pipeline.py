"""A corpus from raw documents in five stages, each written as Parquet and read again.

Null texts have no words and fail the quality rules. Of equal rows and of rows that repeat an id
the near-duplicate stage leaves one; null ids are one id. Columns beside those of documents pass
through all stages but the last, under any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlight.llm.common import Staged, table
from spanlight.llm.decontaminate import without_contaminated
from spanlight.llm.mixing import mix
from spanlight.llm.quality_rules import keep_quality
from spanlight.llm.similar import keep_one
from spanlight.llm.substring_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: sets of five-word shingles with an exact Jaccard similarity of 0.8 or more."""
    return keep_one(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of 20 words go from the texts; a text without words left goes as a whole."""
    return without_repeats(docs, length="n_chars").filter(r"text rlike '[^\\x20\\x09-\\x0D]'")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged.put(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
