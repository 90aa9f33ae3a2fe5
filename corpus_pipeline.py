"""Corpus pipeline: five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from lodestone.llm.stage import new_path

STAGES = [
    ("toxicity", toxicity.pipeline_stage),
    ("near_duplicates", jaccard_join.pipeline_stage),
    ("decontamination", decontaminate.pipeline_stage),
    ("mixing", mixing.pipeline_stage),
    ("token_output", token_store.pipeline_stage),
]

#: The classifier, edit distance and tokenizer stages have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage works on all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
