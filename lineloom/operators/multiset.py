"""Multiset algebra on edge tables: rows of key and ends with a count, never bare sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.operators.graph import ENDS, KEY


def intersect(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The lesser count of every pair that both have."""
    on = [*key, *ENDS]
    return a.join(b.withColumnRenamed("mult", "_m"), on).select(*on, F.least("mult", "_m").alias("mult"))


def minus(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What of ``a`` is left without ``b``; only positive counts."""
    on = [*key, *ENDS]
    return a.join(b.withColumnRenamed("mult", "_m"), on, "left").select(*on, (F.col("mult") - F.coalesce("_m", F.lit(0))).alias("mult")).where("mult > 0")


def plus(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Counts add up: overlapping stamps accumulate."""
    return a.unionByName(b).groupBy(*key, *ENDS).agg(F.sum("mult").alias("mult"))


def union_pairs(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Distinct pairs of either."""
    on = [*key, *ENDS]
    return a.select(*on).union(b.select(*on)).distinct()


def self_consistency(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern of either: whether both have the same strands; nodes do not matter."""
    on = [*key, *ENDS]
    both = a.join(b.withColumnRenamed("mult", "_m"), on, "full_outer")
    return both.groupBy(*key).agg(F.bool_and(F.col("mult").eqNullSafe(F.col("_m"))).alias("consistent"))


def duplicates_source(node: DataFrame, edge: DataFrame, source_node: DataFrame, source_edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: null if the layouts differ, else whether the strands agree."""
    mine, theirs = node.withColumn("_a", F.lit(1)), source_node.withColumn("_b", F.lit(1))
    layout = mine.join(theirs, [*key, "x", "y"], "full_outer").groupBy(*key).agg(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_same"))
    out = layout.join(self_consistency(edge, source_edge, key), list(key), "left")
    return out.select(*key, F.when(F.col("_same"), F.coalesce("consistent", F.lit(True))).alias("duplicates"))


def edge_recall(source: DataFrame, found: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per source pattern: share of its pairs that ``found`` has."""
    on = [*key, *ENDS]
    hit = source.join(found.select(*on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    return hit.groupBy(*key).agg(F.count("*").alias("n_pairs"), F.count("_hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_pairs"))


def motif_library(placement: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Distinct motifs of placements, in order of first use."""
    return placement.groupBy(*key, "motif").agg(F.min("rank").alias("rank"))


def violations(made: DataFrame, stamp: DataFrame, source: DataFrame, key: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """key, *by, violates: whether a stamp on top of ``made`` exceeds the source anywhere; such a stamp is refused whole."""
    on = [*key, *ENDS]
    rows = stamp.join(made.withColumnRenamed("mult", "_made"), on, "left").join(source.withColumnRenamed("mult", "_source"), on, "left")
    over = F.col("n") + F.coalesce("_made", F.lit(0)) > F.coalesce("_source", F.lit(0))
    return rows.groupBy(*key, *by).agg(F.bool_or(over).alias("violates"))
