"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import decontaminate, embeddings, mixing, pii, quality, secrets, simhash, substrings, toxicity, urls
from lineloom.llm.common import crc32_of_id, stored, table
from lineloom.llm.sql import ORACLE


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, distance=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3).drop("source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(quality.described(table(spark, sf_dir, "documents")), "described")
    scored = quality.scored(made, quality.train(made, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_toxicity": op4_toxicity,
    "op5_substrings": op5_substrings,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_pii": op10_pii,
}

#: The others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = ORACLE
