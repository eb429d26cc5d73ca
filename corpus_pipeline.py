"""A training corpus from raw documents: toxicity, near-duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last one says how many words of each document the mix takes. ``run`` applies them in order to the
documents of a folder and writes every stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import decontaminate, mixing, pii, simhash, toxicity
from lineloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. The classifier learns from the labelled rows of the folder's own documents outside the held-out third.

    Null and empty texts score as texts without words; rows that repeat an id are judged each on its own text; a score of exactly 0.7 goes.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(*COLUMNS), model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Null and blank texts are one group. Rows without an id stay; of rows that repeat a kept id all stay.
    """
    return simhash.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover 0.8 or more of a benchmark item; coverage of exactly 0.8 goes. Null and empty texts cover nothing; rows that repeat an id are judged each on its own text."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows the text, nulls stay null. Rows that repeat an id are redacted each on its own."""
    found = pii.find(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.size("base") + F.size("more") > 0
    text = F.when(changed, pii.redacted(F.col("keep_text"), F.concat("base", "more"))).otherwise(F.col("keep_text"))
    done = found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("keep_n_chars")))
    return done.select("doc_id", "text", F.col("keep_lang").alias("lang"), F.col("keep_source").alias("source"), "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row per document, null and blank texts of size 0; of equal quotients the first source or shard in order wins."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL cannot express the classifier, the components of near-duplicates or the tiling; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
