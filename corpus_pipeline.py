"""Corpus pipeline: quality rules, toxicity, exact dedup, near-duplicate
dedup and packing of the ``documents`` table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, every
column as it came (extra ones included). Empty tables pass through; null and
empty texts fall to the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexnet.llm import exact_dedup, ngram_join, packing, quality_rules, toxicity
from plexnet.llm.common import read_table
from plexnet.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts that the base or the certified rules reject go."""
    return quality_rules.keep_good(spark, docs, read_table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: texts scored as toxic go."""
    return toxicity.drop_toxic(spark, docs, read_table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_copies(spark, docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near copies stays."""
    return ngram_join.drop_near_copies(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of the packed sequences."""
    return packing.pack(spark, docs)


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("exact_dedup", dedup_stage),
          ("ngram_join", near_dup_stage), ("packing", packing_stage)]

#: Trained classifiers, MinHash classes and tokenized ids have no SQL form;
#: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the ``documents`` table, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
