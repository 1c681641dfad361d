"""The stages of the pipeline, each a thin call of one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.llm import decontamination, jaccard, mixing, sharding, toxicity
from playlytics.llm.common import free_name, read

TOXIC = 0.7


def held_out() -> Column:
    """Documents whose labels are not learned from; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return toxicity.fit(toxicity.training_rows(read(spark, sf_dir, "documents"), labels))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "toxicity")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), name)
    return scored.where(F.col(name) < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_class(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)
