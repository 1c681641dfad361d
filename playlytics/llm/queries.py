"""The registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlytics.llm import (
    centroids,
    chat,
    decontamination,
    extraction,
    jaccard,
    language,
    licenses,
    mixing,
    neighbours,
    sharding,
    toxicity,
    urls,
    vector_codes,
)
from playlytics.llm.common import materialise, read
from playlytics.llm.stages import TOXIC, held_out, toxicity_model


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = read(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    taken = mixing.assign(materialise(sizes, "sizes"))
    words = F.aggregate("mix.copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    return taken.select(
        "doc_id",
        "size",
        F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"),
        words.alias("taken"),
        F.get("mix.copies", F.lit(0))["position"].alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(read(spark, folder, "documents").select("doc_id"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similarity_classes(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def op4_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract_text(read(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge_urls(read(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("url_weight").alias("weight"))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest(read(spark, folder, "embeddings"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score").orderBy("query_id", "rank")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(read(spark, folder, "documents").select("doc_id", "text"), toxicity_model(spark, folder))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(read(spark, folder, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark(docs, read(spark, folder, "benchmark"))
    hit = decontamination.hit_words(F.col("bm_spans"))
    return found.select(
        "doc_id",
        F.col("bm_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bm_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("bm_items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(read(spark, folder, "conversations"))


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    docs = read(spark, folder, "documents")
    model = language.fit(language.training_rows(docs.where(~held_out)))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(read(spark, folder, "embeddings")).drop("centroid")


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(read(spark, folder, "embeddings"))
    return coded.select(
        "vec_id",
        vector_codes.hex_code().alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_sharding,
        op3_jaccard_join,
        op4_extraction,
        op5_url_filter,
        op6_neighbours,
        op7_toxicity,
        op8_licenses,
        op9_decontamination,
        op10_chat,
        op11_language,
        op12_centroids,
        op13_codes,
    )
}
