"""Summaries, splits, ranks and pages of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max of a column; nulls are skipped."""
    q = [F.percentile(column, F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), *q, F.max(column).alias("max"))


def top(df: DataFrame, by: Column, tie: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows; ties go by ``tie``."""
    return df.orderBy(by, tie).limit(n)


def page(df: DataFrame, order: str, number: int, size: int = 36) -> DataFrame:
    """A page of results, from 1."""
    return df.orderBy(order).offset((number - 1) * size).limit(size)


def cumulative_recall(placed: DataFrame, total: DataFrame, key: Sequence[str], goal: float = 0.95) -> DataFrame:
    """Recall after each rank, and the first rank that reaches ``goal`` (null if none does). ``placed`` has rank and n, ``total`` n_total."""
    w = Window.partitionBy(*key)
    run = placed.withColumn("covered", F.sum("n").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    out = run.join(total, list(key)).withColumn("recall", F.col("covered") / F.col("n_total"))
    return out.withColumn("first_rank", F.min(F.when(F.col("recall") >= goal, F.col("rank"))).over(w))


def search(archive: DataFrame, text: str, id_col: str = "id", prefix: str = "pattern") -> DataFrame:
    """Rows whose id, ``<prefix> <id>`` or ``<prefix>-<id - 1>`` holds the trimmed, lower-cased text; blank text finds all."""
    t = text.strip().lower()
    i = F.col(id_col)
    names = [i.cast("string"), F.concat(F.lit(f"{prefix} "), i.cast("string")), F.concat(F.lit(f"{prefix}-"), (i - 1).cast("string"))]
    return archive if not t else archive.where(names[0].contains(t) | names[1].contains(t) | names[2].contains(t))


def false_positive_rate(per_image: DataFrame) -> DataFrame:
    """Share of images with any detection; null without images."""
    return per_image.agg(F.count("*").alias("n_images"), F.count_if(F.col("n_det") > 0).alias("n_false"), F.avg((F.col("n_det") > 0).cast("double")).alias("rate"))


def decide(new_f1: Column, old_f1: Column, new_fp: Column, old_fp: Column, error: Column, most: float) -> Column:
    """Whether a detector may become the default: better F1, no more false positives (null-safe; an absent rate counts as the worst), small error."""
    return (new_f1 > old_f1) & (F.coalesce(new_fp, F.lit(1.0)) <= F.coalesce(old_fp, F.lit(0.0))) & (error <= most)


def hash_split(df: DataFrame, id_col: str, parts: dict[str, int], seed: int = 42) -> DataFrame:
    """Rows dealt to named parts in the given proportions by a hash of the id: disjoint, and the same in each run."""
    total, at, name = sum(parts.values()), 0, F.lit(None).cast("string")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(total))
    for part, n in reversed(parts.items()):
        at += n
        name = F.when(draw >= total - at, F.lit(part)).otherwise(name) if at == n else F.when((draw >= total - at) & (draw < total - at + n), F.lit(part)).otherwise(name)
    return df.withColumn("part", name)


def failure_reason(n_det: Column, n_truth: Column, f1: Column, error: Column) -> Column:
    """The first rule that holds."""
    return F.when(error.isNotNull(), "error").when(n_det == 0, "nothing_found").when(n_truth == 0, "no_truth").when(f1 < 0.5, "poor_match").when(n_det > 2 * n_truth, "too_many").otherwise("ok")


def neighbours(df: DataFrame, order: str) -> DataFrame:
    """Rows with the ids before and after them."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return df.withColumn("previous", F.lag(order).over(w)).withColumn("following", F.lead(order).over(w))


def ends(df: DataFrame, key: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows of each key."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_f", F.row_number().over(w.orderBy(order))).withColumn("_l", F.row_number().over(w.orderBy(F.desc(order))))
    return ranked.where((F.col("_f") <= n) | (F.col("_l") <= n)).drop("_f", "_l")


def lookup(archive: DataFrame, wanted, id_col: str = "id") -> DataFrame:
    """The row of an id, if there is one; of rows that repeat it any one."""
    return archive.where(F.col(id_col) == wanted).limit(1)


def featured(archive: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    """The rows of a short list of ids."""
    return archive.where(F.col(id_col).isin(list(ids)))
