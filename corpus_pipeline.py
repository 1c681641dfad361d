"""Cleaning of a corpus: toxic texts, near copies, benchmark passages, then the mix and its shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playlytics.llm import stages
from playlytics.llm.common import materialise, read

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("n-gram Jaccard join", stages.drop_near_copies),
    ("benchmark decontamination", stages.remove_benchmark),
    ("mixing", stages.mix_sources),
    ("sharding", stages.place_on_shards),
]

ORACLE_SQL = None  # learned scores and the sampled join are beyond SQL; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again, so that a lost executor costs one stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
