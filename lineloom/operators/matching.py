"""Matching of points within images: by tolerance, by identity, one to one; spacing and symmetry.

Nearest neighbours within a distance are found by buckets: points go to the cell of side ``tol`` that holds them, the other side is
copied to the nine cells around, and an equality join on image and cell brings candidates together. Work follows the points
per cell, not their square per image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = ("image_id",)


def _around(tol: float) -> Column:
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return F.transform(steps, lambda s: F.struct((F.floor(F.col("x") / tol) + s["i"]).alias("cx"), (F.floor(F.col("y") / tol) + s["j"]).alias("cy")))


def close_pairs(a: DataFrame, b: DataFrame, tol: float, image: Sequence[str] = IMAGE, strict: bool = True) -> DataFrame:
    """image, idx, other, dist: points of ``b`` nearer than ``tol`` (or as near, if not ``strict``) to points of ``a``. Both have idx, x, y."""
    left = a.select(*image, "idx", "x", "y", F.floor(F.col("x") / tol).alias("cx"), F.floor(F.col("y") / tol).alias("cy"))
    right = b.select(*image, F.col("idx").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(_around(tol)).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = left.join(right, [*image, "cx", "cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return near.where((F.col("dist") < tol) if strict else (F.col("dist") <= tol)).select(*image, "idx", "other", "dist")


def nearest(a: DataFrame, b: DataFrame, tol: float, image: Sequence[str] = IMAGE, strict: bool = True) -> DataFrame:
    """image, idx, other, dist: the nearest point of ``b`` for each point of ``a`` that has one; of equally near ones the least idx."""
    near = close_pairs(a, b, tol, image, strict)
    best = near.groupBy(*image, "idx").agg(F.min(F.struct("dist", "other")).alias("m"))
    return best.select(*image, "idx", F.col("m.other").alias("other"), F.col("m.dist").alias("dist"))


def match_metrics(det: DataFrame, truth: DataFrame, tol: float = 6.0, image: Sequence[str] = IMAGE, empty_truth_recall: float | None = 1.0) -> DataFrame:
    """Per image of either: n_det, n_truth, matched in both directions (not one to one), precision, recall, f1.

    Empty sides: both 1 and 1; no detection 1 and 0; no truth 0 and ``empty_truth_recall``.
    """
    hit_d = close_pairs(det, truth, tol, image).select(*image, "idx").distinct().groupBy(*image).agg(F.count("*").alias("hit_det"))
    hit_t = close_pairs(truth, det, tol, image).select(*image, "idx").distinct().groupBy(*image).agg(F.count("*").alias("hit_truth"))
    n = det.groupBy(*image).agg(F.count("*").alias("n_det")).join(truth.groupBy(*image).agg(F.count("*").alias("n_truth")), list(image), "full_outer")
    out = n.join(hit_d, list(image), "left").join(hit_t, list(image), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_det", "n_truth", "hit_det", "hit_truth")})
    p = F.when(F.col("n_det") == 0, 1.0).when(F.col("n_truth") == 0, 0.0).otherwise(F.col("hit_det") / F.col("n_det"))
    none = F.lit(empty_truth_recall).cast("double")
    r = F.when((F.col("n_det") == 0) & (F.col("n_truth") == 0), F.lit(1.0)).when(F.col("n_truth") == 0, none).otherwise(F.col("hit_truth") / F.col("n_truth"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(both * 0))


def agreement(a: DataFrame, b: DataFrame, tol: float = 6.0, image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image: n_a, n_b, n_agree (points of ``a`` with one of ``b`` in reach, many to one), a_only, b_only (may be negative)."""
    hit = close_pairs(a, b, tol, image).select(*image, "idx").distinct().groupBy(*image).agg(F.count("*").alias("n_agree"))
    n = a.groupBy(*image).agg(F.count("*").alias("n_a")).join(b.groupBy(*image).agg(F.count("*").alias("n_b")), list(image), "full_outer")
    out = n.join(hit, list(image), "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_a", "n_b", "n_agree")})
    return out.withColumn("a_only", F.col("n_a") - F.col("n_agree")).withColumn("b_only", F.col("n_b") - F.col("n_agree"))


def one_to_one(a: DataFrame, b: DataFrame, tol: float = 6.0, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, idx, other: each point of ``a``, by idx, takes the nearest point of ``b`` in reach that is still free.

    Every choice depends on those before, so the close pairs of an image are one group; far pairs never enter it.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        for idx, other in g.sort_values(["idx", "dist", "other"])[["idx", "other"]].itertuples(index=False):
            if (not rows or rows[-1][0] != idx) and other not in taken:
                taken.add(other)
                rows.append((idx, other))
        out = pd.DataFrame(rows, columns=["idx", "other"])
        for k in reversed(image):
            out.insert(0, k, g[k].iloc[0])
        return out

    near = close_pairs(a, b, tol, image)
    kinds = ", ".join(f"{k} {near.schema[k].dataType.simpleString()}" for k in image)
    return near.groupBy(*image).applyInPandas(run, f"{kinds}, idx bigint, other bigint")


def remap_edges(edge: DataFrame, identity: DataFrame, image: Sequence[str] = IMAGE) -> DataFrame:
    """Edges between detections (a, b) as edges between the true points they stand for; edges with an unmatched end are dropped."""
    m = identity.select(*image, "idx", "other")
    for end in ("a", "b"):
        edge = edge.join(m.withColumnsRenamed({"idx": end, "other": f"{end}_true"}), [*image, end])
    return edge


def neighbour_distances(points: DataFrame, reach: float, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, idx, dist: distance to the nearest other point, at any distance; null for a point that is alone in its image.

    Points with a neighbour within ``reach`` find it in buckets; only those left without are compared with all points of their image.
    """
    near = close_pairs(points, points, reach, image, strict=False).where("idx <> other")
    best = near.groupBy(*image, "idx").agg(F.min("dist").alias("dist"))
    lone = points.join(best, [*image, "idx"], "left_anti").select(*image, "idx", "x", "y")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    others = points.select(*image, F.col("idx").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    far = lone.join(others, list(image)).where("idx <> other").groupBy(*image, "idx").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("dist"))
    return points.select(*image, "idx").join(best.unionByName(far), [*image, "idx"], "left")


def dot_radius(points: DataFrame, reach: float, image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image: median spacing and radius, 0.3 of it; below two points the radius is 5. ``reach`` only sets the size of the buckets."""
    d = neighbour_distances(points, reach, image)
    out = d.groupBy(*image).agg(F.count("*").alias("n_points"), F.percentile("dist", F.lit(0.5)).alias("spacing"))
    return out.withColumn("radius", F.coalesce(F.when(F.col("n_points") >= 2, F.col("spacing") * 0.3), F.lit(5.0)))


def component_pairs(member: DataFrame, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, component, a, b: all pairs of hubs that touch one component; components with fewer than two give none.

    ``member`` has component and hub; a drawn stroke touches few hubs.
    """
    hubs = member.groupBy(*image, "component").agg(F.array_sort(F.collect_set("hub")).alias("h")).where(F.size("h") > 1)
    first = hubs.select(*image, "component", F.posexplode("h").alias("i", "a"), "h")
    return first.select(*image, "component", "a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b"))


SYMMETRIES = {"vertical": (-1, 1), "horizontal": (1, -1), "rotation180": (-1, -1)}


def symmetry_errors(points: DataFrame, key: Sequence[str], chunk: int = 256) -> DataFrame:
    """key and, per symmetry, the mean distance from each point's image to the nearest point, after centring.

    The nearest point may be any of the pattern's, so a pattern is a group; distances are taken in chunks of rows.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y"]].to_numpy(float)
        p = p - p.mean(axis=0)
        row = {k: g[k].iloc[0] for k in key}
        for name, s in SYMMETRIES.items():
            q = p * s
            least = [np.sqrt(((q[i : i + chunk, None] - p[None]) ** 2).sum(2).min(1)) for i in range(0, len(q), chunk)]
            row[name] = float(np.concatenate(least).mean())
        return pd.DataFrame([row])

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in key)
    return points.select(*key, "x", "y").groupBy(*key).applyInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in SYMMETRIES))


def rank_within(df: DataFrame, by: Sequence[Column], key: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank``, its row number within ``key`` in the order of ``by``."""
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint"))
