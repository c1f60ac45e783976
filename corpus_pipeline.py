"""A corpus from the documents table, in five stages. Each works on all that the one before kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelane.llm import mixing, ngram_join, pii, spm, toxicity
from tracelane.llm.common import scratch

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", spm.stage),
]

#: The stages' models and sets of shingles have no SQL form; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' results lie in the shared folder while they are needed."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
