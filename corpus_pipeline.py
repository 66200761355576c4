"""Corpus pipeline: quality rules, exact dedup, near-dedup, packing, each stage written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact_dedup, packing, quality, simhash
from tidelog.llm.common import table, written

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_dedup", simhash.stage),
    ("best_fit_packing", packing.stage),
]
#: The perplexity model and the bins are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
