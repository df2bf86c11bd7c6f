"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, pipeline

STAGES = [
    ("language", pipeline.language),
    ("lines", pipeline.lines),
    ("near_copies", pipeline.near_copies),
    ("benchmark", pipeline.benchmark),
    ("mixture", pipeline.mixture),
]

#: Trained models and MinHash can't be said in SQL; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
