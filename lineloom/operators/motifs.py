"""Local windows, motifs, candidates and their cost.

The box neighbourhood of a centre is not joined by a range condition: every edge lists the centres whose box holds it, and
an equality join keeps the interior ones, so the work is linear in edges times the box area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.lattice import MOTIF, canonical_motif, find_transform
from lineloom.operators.graph import ENDS, KEY


def interior(node: DataFrame, radius: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """Dots at least ``radius`` inside the bounding box of their pattern's dots."""
    w = Window.partitionBy(*key)
    inside = [F.col(c).between(F.min(c).over(w) + radius, F.max(c).over(w) - radius) for c in ("x", "y")]
    return node.withColumn("_in", inside[0] & inside[1]).where("_in").drop("_in")


def windows(node: DataFrame, edge: DataFrame, radius: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """key, x, y, motif: the strands within the box of each interior dot, relative to it; empty windows are kept."""
    centre = interior(node, radius, key).select(*key, "x", "y")
    lo = lambda a, b: F.greatest(a, b) - radius
    hi = lambda a, b: F.least(a, b) + radius
    fits = edge.where((lo("ax", "bx") <= hi("ax", "bx")) & (lo("ay", "by") <= hi("ay", "by")))
    at = fits.withColumn("x", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("y", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    rel = F.array(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"), F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
    held = at.join(centre, [*key, "x", "y"], "left_semi")
    found = held.groupBy(*key, "x", "y").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat(rel, F.col("mult").cast("int"))))).alias("motif"))
    return centre.join(found, [*key, "x", "y"], "left").withColumn("motif", F.coalesce("motif", F.array().cast(MOTIF)))


def canonical_windows(window: DataFrame) -> DataFrame:
    """Windows with their canonical form and the transform that takes it to the window."""
    w = window.withColumn("canon", canonical_motif(F.col("motif")))
    return w.withColumn("transform", find_transform(F.col("canon"), F.col("motif")))


def dominant(window: DataFrame, column: str = "motif", key: Sequence[str] = KEY) -> DataFrame:
    """key, <column>, n, n_interior, coverage: the most frequent window, of equally frequent ones the least.

    With ``motif`` windows must be equal, with ``canon`` equal up to symmetry. Empty windows count and can win.
    """
    n = window.groupBy(*key, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    best = n.withColumn("n_interior", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), column)))
    return best.where("_r = 1").select(*key, column, "n", "n_interior", (F.col("n") / F.col("n_interior")).alias("coverage"))


def candidate_groups(window: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, canon, n_points, points: interior points by canonical window, empty windows left out. Points are in order."""
    w = window if "canon" in window.columns else canonical_windows(window)
    some = w.where(F.size("canon") > 0)
    return some.groupBy(*key, "canon").agg(F.count("*").alias("n_points"), F.array_sort(F.collect_list(F.struct("x", "y", "transform"))).alias("points"))


def stamp(placement: DataFrame, node: DataFrame, key: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """key, *by, ends, n: strands per pair that stamping motifs at points makes; pairs off the dots are dropped.

    ``placement`` has key, by, x, y and motif, the window as it lies (after its transform).
    """
    e = placement.select(*key, *by, "x", "y", F.explode("motif").alias("e"))
    at = [(F.get("e", i) + F.col("x" if i % 2 == 0 else "y")).alias(c) for i, c in enumerate(ENDS)]
    made = e.select(*key, *by, *at)
    for p in ("a", "b"):
        made = made.join(node.select(*key, F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")), [*key, f"{p}x", f"{p}y"], "left_semi")
    return made.groupBy(*key, *by, *ENDS).agg(F.count("*").alias("n"))


#: Cost of an edge (and of a residual strand) and of a placement in the description of a pattern.
EDGE_COST, PLACEMENT_COST = 4, 3


def description_size(n_motif_edges: Column, n_points: Column, n_residual: Column) -> Column:
    """Sum over placed motifs of edges and points, plus the residual (sums are the caller's)."""
    return EDGE_COST * n_motif_edges + PLACEMENT_COST * n_points + EDGE_COST * n_residual


def compression_ratio(n_strands: Column, size: Column) -> Column:
    """Cost of all strands one by one over the size; with size 0: infinite for an empty pattern, else 0."""
    return F.when(size > 0, EDGE_COST * n_strands / size).when(n_strands == 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def mdl_gain(new_strands: Column, motif_edges: Column, is_new: Column, n_points: Column) -> Column:
    """What placing a motif saves: strands covered, less the motif (only when first used) and its placements."""
    return EDGE_COST * new_strands - F.when(is_new, EDGE_COST * motif_edges).otherwise(0) - PLACEMENT_COST * n_points


def analyse_symmetry(node: DataFrame | None, edge: DataFrame, radius: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """The most frequent window up to symmetry and its coverage, per pattern. The dots are not optional: they bound the interior."""
    if node is None:
        raise TypeError("symmetry needs the dots of the layout")
    return dominant(canonical_windows(windows(node, edge, radius, key)), "canon", key)
