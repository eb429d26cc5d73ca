"""Sets of images and detectors: who belongs where, parameter grids, sweeps, diagnosis of heatmaps and of their resolution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.operators import heatmap, matching

IMAGE = ("image_id",)


def population(image: Column, excluded: Sequence, in_scope: Sequence) -> Column:
    """``excluded``, ``in_scope`` or, for every other image, ``no_dots``."""
    return F.when(image.isin(list(excluded)), "excluded").when(image.isin(list(in_scope)), "in_scope").otherwise("no_dots")


def compared(per_image: DataFrame, by: Sequence[str], low: Column | None = None) -> DataFrame:
    """Averages of per-image precision, recall and error (nulls skipped), failed images, over all and over those where ``low`` holds."""
    names = {"": F.lit(True)} | ({"low_": low} if low is not None else {})
    out = []
    for prefix, only in names.items():
        out.append(F.count_if(only).alias(f"{prefix}n_images"))
        out += [F.avg(F.when(only, F.col(c))).alias(f"{prefix}{c}") for c in ("precision", "recall")]
    return per_image.groupBy(*by).agg(*out)


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of named parameter values; the lists are short by nature."""
    out = None
    for name, v in values.items():
        one = spark.createDataFrame([(x,) for x in v], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def representatives(density: DataFrame, n_col: str, tie: str, below: float = 300) -> DataFrame:
    """The image of least, of most and of middle density among those below ``below`` (among all if there is none); one row per image, with its roles.

    One pass finds the counts; rows get their ranks by aggregation of what is smaller, so no image's row leaves its partition for a rank.
    """
    order = F.struct(n_col, tie)
    ends = density.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count_if(F.col(n_col) < below).alias("_n_low"), F.count("*").alias("_n"))
    few = density.groupBy(n_col).agg(F.count("*").alias("_m"))  # one row per density value
    upto = few.withColumn("_before", F.coalesce(F.sum("_m").over(Window.orderBy(n_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.when(F.col("_n_low") > 0, F.floor(F.col("_n_low") / 2)).otherwise(F.floor(F.col("_n") / 2))
    at = upto.crossJoin(F.broadcast(ends)).where((F.col("_before") <= place) & (place < F.col("_before") + F.col("_m"))).select(F.col(n_col).alias("_value"), (place - F.col("_before")).alias("_skip"))
    among = density.join(F.broadcast(at), F.col(n_col) == F.col("_value"))
    middle = among.withColumn("_r", F.row_number().over(Window.partitionBy("_value").orderBy(tie)) - 1).where("_r = _skip").select(tie, n_col, F.lit("middle").alias("role"))
    edge = ends.select(F.explode(F.array(*[F.struct(F.col(c)[tie].alias(tie), F.col(c)[n_col].alias(n_col), F.lit(r).alias("role")) for c, r in (("_lo", "lowest"), ("_hi", "highest"))])).alias("e")).select("e.*")
    return edge.unionByName(middle).groupBy(tie, n_col).agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"))


def density_survey(density: DataFrame, n_col: str) -> DataFrame:
    """Images, least and greatest density, how many densities there are."""
    return density.agg(F.count("*").alias("n_images"), F.min(n_col).alias("least"), F.max(n_col).alias("most"), F.countDistinct(n_col).alias("n_values"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Least, greatest and exact median of a column; nulls are skipped."""
    return df.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.percentile(column, F.lit(0.5)).alias("median"))


def shared_members(df: DataFrame, part: str, member: str) -> DataFrame:
    """Pairs of parts with a member in common and how many; no row where all parts are disjoint. A member is in few parts."""
    parts = df.groupBy(member).agg(F.array_sort(F.collect_set(part)).alias("p")).where(F.size("p") > 1)
    a = parts.select(F.posexplode("p").alias("i", "a"), "p")
    return a.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def side_by_side(a: DataFrame, b: DataFrame, tol: float = 6.0, image: Sequence[str] = IMAGE) -> DataFrame:
    """Two detectors' results per image of either: counts, errors, and where neither failed how many dots agree.

    Both have image, idx, x, y; a row without idx stands for an image that failed, with its ``error``.
    """
    sides = []
    for name, d in (("a", a), ("b", b)):
        sides.append(d.groupBy(*image).agg(F.count("idx").alias(f"n_{name}"), F.max("error").alias(f"error_{name}")))
    agree = matching.agreement(a.where("idx is not null"), b.where("idx is not null"), tol, image).select(*image, "n_agree")
    out = sides[0].join(sides[1], list(image), "full_outer").join(agree, list(image), "left")
    both = F.col("error_a").isNull() & F.col("error_b").isNull() & F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    out = out.withColumn("n_agree", F.when(both, F.coalesce("n_agree", F.lit(0).cast("bigint"))))
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_a", "n_b")}).withColumn("a_only", F.col("n_a") - F.col("n_agree")).withColumn("b_only", F.col("n_b") - F.col("n_agree"))


def separability(points: DataFrame, resolutions: Sequence[int], source_size: float, sigma: float, reach: float, image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image and resolution: dots, cells they round to, dots lost to a shared cell, median distance to the next dot in cells, share of dots with one within 2 and 3 sigma.

    Distances are found once, in pixels, and scaled. Distances and shares are null for a single dot.
    """
    d = matching.neighbour_distances(points, reach, image)
    res = F.array(*[F.lit(r) for r in resolutions])
    cells = points.select(*image, "x", "y", F.explode(res).alias("resolution"))
    at = [F.bround(F.col(c) * (F.col("resolution") / F.lit(float(source_size)))) for c in "xy"]
    n = cells.groupBy(*image, "resolution").agg(F.count("*").alias("n_dots"), F.countDistinct(*at).alias("n_cells"))
    far = d.select(*image, "dist", F.explode(res).alias("resolution")).withColumn("cells", F.col("dist") * (F.col("resolution") / F.lit(float(source_size))))
    near = far.groupBy(*image, "resolution").agg(F.percentile("cells", F.lit(0.5)).alias("median"), *[F.avg((F.col("cells") < k * sigma).cast("double")).alias(f"within_{k}_sigma") for k in (2, 3)])
    return n.join(near, [*image, "resolution"]).withColumn("n_lost", F.col("n_dots") - F.col("n_cells"))


def no_dot_false_positives(heat: DataFrame | heatmap.Targets, images: DataFrame, size: int, floor: float = 0.2) -> DataFrame:
    """Over images without dots: how many have local maxima of at least ``floor``, how many an image has, mean and standard deviation of the place of the highest cell, as a share of the heatmap.

    A heatmap without any cell has its highest cell at 0, 0. Each heatmap is read once and sends one row.
    """

    def read(group, row, col, v):
        if not len(v):
            return group, [group, row.astype(np.int32), col.astype(np.int32)]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        high = np.flatnonzero(v >= floor)
        found = high[heatmap.highest_around(group[high], row[high], col[high], v[high])]
        at = np.flatnonzero(v == np.repeat(np.maximum.reduceat(v, first), np.diff(np.r_[first, len(v)])))
        top = at[np.searchsorted(at, first)]
        n = np.searchsorted(found, np.r_[first[1:], len(v)]) - np.searchsorted(found, first)
        return group[first], [n, row[top].astype(np.int32), col[top].astype(np.int32)]

    tops = heatmap.each(heat, read, "n bigint, r int, c int", None)
    at = images.select("image_id").distinct().join(tops, "image_id", "left")
    at = at.select(F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(F.col(c) / size, F.lit(0.0)).alias(c) for c in "rc"])
    return at.agg(F.count("*").alias("n_images"), F.count_if(F.col("n") > 0).alias("n_false"), F.avg("n").alias("mean_peaks"), F.avg("c").alias("mean_x"), F.avg("r").alias("mean_y"), F.stddev_pop("c").alias("std_x"), F.stddev_pop("r").alias("std_y"))


def peak_sweep(heat: DataFrame | heatmap.Targets, truth: DataFrame, cell: float, thresholds: Sequence[float], distances: Sequence[float], tol: float, width: int = 128) -> DataFrame:
    """Per setting: mean precision, mean recall (images without truth have none), F1 of the means, peaks per image; best first by F1.

    ``heat`` has image_id, row, col, v; ``truth`` image_id, idx, x, y in pixels; a cell is ``cell`` pixels wide. All settings are
    tried where a heatmap is read; a cell that is a peak under any is sent once with the settings that chose it, and meets the image's truth there.
    """
    settings = [(t, d) for t in thresholds for d in distances]

    def read(group, row, col, v):
        def one(part):
            r, c, x = row[part], col[part], v[part]
            chosen = np.zeros((len(x), len(settings)), bool)
            for d in set(distances):
                at = np.array(heatmap.suppressed(r, c, x, min(thresholds), d, width), np.int64)
                for k, (t, e) in enumerate(settings):
                    if e == d:
                        chosen[at[x[at] >= t], k] = True  # a higher threshold ends the same row of peaks sooner
            some = np.flatnonzero(chosen.any(axis=1))
            sent = np.empty(len(some), object)
            sent[:] = [bits.tobytes() for bits in np.packbits(chosen[some], axis=1)]
            return [r[some].astype(np.int64), c[some].astype(np.int64), sent]

        again, columns = heatmap.of_each(group, 3, one)
        return again, [columns[0], columns[1], pa.array(columns[2], pa.binary())] if columns else [group, group, pa.array([], pa.binary())]

    def met(key, det: pa.Table, want: pa.Table) -> pa.Table:
        x, y, cx, cy = (np.array(c.to_numpy(), float) for c in (want.column("x"), want.column("y"), det.column("col"), det.column("row")))
        packed = np.frombuffer(b"".join(det.column("chosen").to_pylist()), np.uint8).reshape(det.num_rows, -(-len(settings) // 8))
        chosen = np.unpackbits(packed, axis=1, count=len(settings)).astype(bool)
        n_truth, hit, found = len(x), np.zeros(len(cx), bool), []
        for lo in range(0, n_truth, block := max(1, (1 << 20) // max(1, len(cx)))):
            dx, dy = cx[:, None] * cell - x[lo : lo + block], cy[:, None] * cell - y[lo : lo + block]
            near = np.sqrt(dx * dx + dy * dy) < tol
            hit |= near.any(axis=1)
            found.append((near.T.astype(np.float32) @ chosen.astype(np.float32)) > 0)
        seen, idx = np.concatenate(found) if found else np.zeros((0, len(settings)), bool), np.array(want.column("idx").to_pylist())
        n_det, hit_det = chosen.sum(axis=0), chosen[hit].sum(axis=0)
        hit_truth = np.array([len(np.unique(idx[s])) for s in seen.T]) if n_truth else np.zeros(len(settings))
        p = np.where(n_det == 0, 1.0, hit_det / np.maximum(n_det, 1)) if n_truth else np.zeros(len(settings))
        rec = pa.array(hit_truth / n_truth, pa.float64()) if n_truth else pa.nulls(len(settings), pa.float64())
        t = pa.table({"threshold": pa.array([float(t) for t, _ in settings]), "min_distance": pa.array([float(d) for _, d in settings]), "n_det": pa.array(n_det, pa.int64()), "precision": pa.array(p, pa.float64()), "recall": rec})
        return t if n_truth else t.filter(pa.array(n_det > 0))

    kind = lambda df: df.select("image_id", "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    det = heatmap.each(heat, read, "row bigint, col bigint, chosen binary", min(thresholds))
    m = det.groupBy("image_id").cogroup(kind(truth).groupBy("image_id")).applyInArrow(met, "threshold double, min_distance double, n_det bigint, precision double, recall double")
    by = m.groupBy("threshold", "min_distance").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("n_det").alias("avg_peaks"))
    p, r = F.col("precision"), F.col("recall")
    return by.withColumn("f1", F.when((r > 0) & (p + r > 0), 2 * p * r / (p + r)).otherwise(0.0)).orderBy(F.desc("f1"), "threshold", "min_distance")


def nearest_distances(a: DataFrame, b: DataFrame, reach: float, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, idx, dist: for each point of ``a`` the distance to the nearest point of ``b``, at any distance; null where the image has none.

    Points with one within ``reach`` find it in buckets, the others are compared with all of ``b`` in their image.
    """
    near = matching.nearest(a, b, reach, image, strict=False).select(*image, "idx", "dist")
    lone = a.join(near, [*image, "idx"], "left_anti").select(*image, "idx", "x", "y")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    all_b = b.select(*image, F.col("x").alias("ox"), F.col("y").alias("oy"))
    far = lone.join(all_b, list(image)).groupBy(*image, "idx").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("dist"))
    return a.select(*image, "idx").join(near.unionByName(far), [*image, "idx"], "left")


def distance_stats(a: DataFrame, b: DataFrame, reach: float, image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image of ``a``: mean, exact median, least and greatest distance to the nearest point of ``b``; nulls where there is none."""
    d = nearest_distances(a, b, reach, image)
    return d.groupBy(*image).agg(F.avg("dist").alias("mean"), F.percentile("dist", F.lit(0.5)).alias("median"), F.min("dist").alias("least"), F.max("dist").alias("most"))


def pixel_frame(node: DataFrame, key: Sequence[str], size: float = 900.0, margin: float = 90.0) -> DataFrame:
    """key, x, y, px, py: dots of a pattern scaled into a square image with a margin, centred; a single row or column counts as one step wide."""
    box = node.groupBy(*key).agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    usable = size - 2 * margin
    span = {c: F.greatest(F.col(f"_max_{c}") - F.col(f"_min_{c}"), F.lit(1)) for c in "xy"}
    scale = usable / F.greatest(span["x"], span["y"])
    at = {c: F.col(c) * scale + margin - F.col(f"_min_{c}") * scale + (usable - span[c] * scale) / 2 for c in "xy"}
    return node.join(box, list(key)).select(*key, "x", "y", at["x"].alias("px"), at["y"].alias("py"))
