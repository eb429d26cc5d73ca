"""Heatmaps and gray images: Gaussian targets, local maxima, non-maximum suppression, thresholds.

A heatmap has far more cells than its image has points, so cells are not shuffled: the points of an image meet in one task, which keeps the grids of a few
images and hands each finished one to the operator that reads it. Heatmaps that come as a table of cells go through the same operators, sorted by image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

IMAGE = ("image_id",)
#: Grids of so many cells, and distances of so many pairs, are held at once.
_CELLS, _PAIRS = 1 << 20, 1 << 20
#: Operators on whole heatmaps: from image number, row, col, v, sorted by the first three, to image number and columns.
Reader = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list]]


def _begins(batch: pa.RecordBatch, n_keys: int, last: tuple | None) -> np.ndarray:
    """Rows at which another image begins; ``last`` is the image of the row before the batch."""
    new = np.zeros(batch.num_rows, bool)
    for c in range(n_keys):
        code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    new[0] = tuple(batch.column(c)[0].as_py() for c in range(n_keys)) != last
    return np.flatnonzero(new)


def _told(names: Sequence[str], keys: list[pa.Array], found: tuple[np.ndarray, list]) -> pa.RecordBatch:
    group, columns = found
    at = pa.array(group, pa.int64())
    return pa.RecordBatch.from_arrays([k.take(at) for k in keys] + [pa.array(c) for c in columns], list(names))


class Targets:
    """The heatmaps of points: the largest of the points' Gaussians in every cell within ``reach`` of a point's cell.

    Points without a place (null or NaN) have no cell; repeated points change nothing. Memory follows the size of a grid, not the points of an image.
    """

    def __init__(self, points: DataFrame, size: int, source_size: float, sigma: float = 1.2, reach: int = 4, image: Sequence[str] = IMAGE) -> None:
        self.points, self.size, self.source_size, self.sigma, self.reach, self.image = points, size, float(source_size), sigma, reach, tuple(image)
        self.kinds = [points.schema[k] for k in image]
        self.cell_kinds = [StructField("row", IntegerType()), StructField("col", IntegerType())]

    def each(self, read: Reader, columns: str, least: float | None = None) -> DataFrame:
        """image and ``columns`` as ``read`` makes them of every heatmap; cells below ``least`` are left out."""
        size, source_size, reach, n_keys, across = self.size, self.source_size, self.reach, len(self.image), 2 * self.sigma * self.sigma
        farthest = np.inf if least is None or least <= 0 else max(0.0, -across * math.log(least)) * (1 + 1e-9) + 1e-9
        at_once, names = max(1, _CELLS // size**2), [*self.image, *(c.split()[0] for c in columns.split(", "))]
        step = np.arange(-reach, reach + 1)

        def nearest(grid: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            """Lowers ``grid`` to the squared distances of its cells to the points."""
            for lo in range(0, len(x), max(1, _PAIRS // len(step) ** 2)):
                part = slice(lo, lo + max(1, _PAIRS // len(step) ** 2))
                cx, cy = x[part, None] / source_size * size, y[part, None] / source_size * size
                col, row = np.floor(cx).astype(np.int64) + step, np.floor(cy).astype(np.int64) + step
                dx, dy = (cx - col) ** 2, (cy - row) ** 2
                dx[(col < 0) | (col >= size)] = np.inf
                dy[(row < 0) | (row >= size)] = np.inf
                at = (group[part, None] * size + np.clip(row, 0, size - 1)) * size
                np.minimum.at(grid.reshape(-1), (at[:, :, None] + np.clip(col, 0, size - 1)[:, None, :]).reshape(-1), (dx[:, None, :] + dy[:, :, None]).reshape(-1))

        def cells(grid: np.ndarray):
            at = np.flatnonzero(grid.reshape(-1) <= min(farthest, np.finfo(float).max))
            t = -grid.reshape(-1)[at] / across
            v = np.fromiter(map(math.exp, t.tolist()), float, len(t))  # as the C library has it: numpy's own differs in last bits, which parts equal cells
            if least is not None:
                at, v = at[v >= least], v[v >= least]
            group, cell = np.divmod(at, size * size)
            row, col = np.divmod(cell, size)
            return group, row.astype(np.int32), col.astype(np.int32), v

        def run(batches):
            last, open_keys, rest = None, None, None  # the image that has not ended, and its grid
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = _begins(batch, n_keys, last)
                keys = [batch.column(c).take(pa.array(at)) for c in range(n_keys)]
                if rest is not None:
                    keys = [pa.concat_arrays(pair) for pair in zip(open_keys, keys, strict=True)]
                group = np.zeros(batch.num_rows, np.int64)
                group[at] = 1
                group = np.cumsum(group) - (rest is None)
                x, y = (batch.column(n_keys + k).to_numpy(zero_copy_only=False) for k in range(2))
                n = int(group[-1]) + 1
                for first in range(0, n, at_once):
                    m = min(at_once, n - first)
                    grid = np.full((m, size * size), np.inf)
                    if first == 0 and rest is not None:
                        grid[0] = rest
                    lo, hi = np.searchsorted(group, (first, first + m))
                    nearest(grid, group[lo:hi] - first, x[lo:hi], y[lo:hi])
                    done = m - (first + m == n)
                    if done:
                        yield _told(names, [k.slice(first, done) for k in keys], read(*cells(grid[:done])))
                rest, open_keys = grid[-1].copy(), [k.slice(n - 1, 1) for k in keys]
                last = tuple(k[0].as_py() for k in open_keys)
            if rest is not None:
                yield _told(names, open_keys, read(*cells(rest[None])))

        cx, cy = (F.col(c) / F.lit(source_size) * size for c in "xy")
        inside = (F.floor(cx) - reach < size) & (F.floor(cy) - reach < size) & (cx + reach >= 0) & (cy + reach >= 0) & ~F.isnan("x") & ~F.isnan("y")
        places = self.points.select(*self.image, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(inside)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.kinds)
        return places.repartition(*self.image).sortWithinPartitions(*self.image).mapInArrow(run, f"{kinds}, {columns}")

    def cells(self) -> DataFrame:
        """image, row, col, v"""
        return self.each(lambda group, row, col, v: (group, [row, col, v]), "row int, col int, v double")


def _of_table(heat: DataFrame, read: Reader, columns: str, least: float | None, image: Sequence[str]) -> DataFrame:
    """``Targets.each`` for a table of cells; an image's cells are held together. Cells without a value are left out."""
    n_keys, names = len(image), [*image, *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        held, last = [], None

        def read_all(parts):
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            at = _begins(t, n_keys, None)
            at[:1] = 0
            group = np.zeros(t.num_rows, np.int64)
            group[at] = 1
            cells = [t.column(n_keys + k).to_numpy(zero_copy_only=False) for k in range(3)]
            return _told(names, [t.column(c).take(pa.array(at)) for c in range(n_keys)], read(np.cumsum(group) - 1, *cells))

        for batch in batches:
            if not batch.num_rows:
                continue
            at = _begins(batch, n_keys, last)
            if len(at):
                if held or at[-1]:
                    yield read_all([*held, batch.slice(0, at[-1])])
                held, batch = [], batch.slice(at[-1])
            held.append(batch)
            last = tuple(batch.column(c)[0].as_py() for c in range(n_keys))
        if held:
            yield read_all(held)

    kept = heat.select(*image, "row", "col", F.col("v").cast("double").alias("v")).where("v is not null" if least is None else F.col("v") >= least)
    kinds = ", ".join(f"`{k}` {heat.schema[k].dataType.simpleString()}" for k in image)
    return kept.repartition(*image).sortWithinPartitions(*image, "row", "col").mapInArrow(run, f"{kinds}, {columns}")


def each(heat: DataFrame | Targets, read: Reader, columns: str, least: float | None = None, image: Sequence[str] = IMAGE) -> DataFrame:
    """image and ``columns`` as ``read`` makes them of every heatmap, from points or from a table with image, row, col, v; cells below ``least`` are left out."""
    return heat.each(read, columns, least) if isinstance(heat, Targets) else _of_table(heat, read, columns, least, image)


def _cell_kinds(heat: DataFrame | Targets) -> str:
    fields = heat.cell_kinds if isinstance(heat, Targets) else [heat.schema[c] for c in ("row", "col")]
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)


def gaussian(points: DataFrame, size: int, source_size: float, sigma: float = 1.2, reach: int = 4, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, row, col, v: the largest of the points' Gaussians in every cell within ``reach`` of a point's cell."""
    return Targets(points, size, source_size, sigma, reach, image).cells()


def highest_around(group: np.ndarray, row: np.ndarray, col: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether no cell of the 3 x 3 neighbourhood exceeds a cell, among cells sorted by image, row and col."""
    if not len(v):
        return np.zeros(0, bool)
    row, col = row.astype(np.int64) - int(row.min()) + 1, col.astype(np.int64) - int(col.min()) + 1
    wide = int(col.max()) + 2
    key = (group * (int(row.max()) + 2) + row) * wide + col
    cell, first = np.unique(key, return_index=True)
    most = np.maximum.reduceat(np.where(np.isnan(v), np.inf, v), first)
    best = most.copy()
    for step in (-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1):
        at = np.minimum(np.searchsorted(cell, cell + step), len(cell) - 1)
        best = np.where(cell[at] == cell + step, np.maximum(best, most[at]), best)
    return ~(v < best[np.searchsorted(cell, key)])


def local_maxima(heat: DataFrame | Targets, floor: float = 0.2, image: Sequence[str] = IMAGE) -> DataFrame:
    """Cells of at least ``floor`` that no cell of their 3 x 3 neighbourhood exceeds; absent cells are 0. Cells below the floor exceed none of these."""

    def read(group, row, col, v):
        top = highest_around(group, row, col, v)
        return group[top], [row[top], col[top], v[top]]

    return each(heat, read, f"{_cell_kinds(heat)}, v double", floor, image)


def suppressed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, threshold: float, min_distance: float, width: int) -> list[int]:
    """Indices of peaks, strongest first: each drops all others within ``min_distance``; ties go to the lower flat index.

    A lower threshold only adds weaker peaks at the end.
    """
    keep = np.flatnonzero(values >= threshold)
    order = keep[np.lexsort((rows[keep] * width + cols[keep], -values[keep]))]
    if not len(order):
        return []
    r, c = rows[order].astype(np.int64), cols[order].astype(np.int64)
    far = int(max(min_distance, 0))
    if (2 * far + 1) ** 2 > 16 * len(order) + 49:  # the disc has more cells than there are to drop
        alive, out = np.ones(len(order), bool), []
        for k, i in enumerate(order):
            if alive[k]:
                out.append(int(i))
                alive &= np.hypot(r - r[k], c - c[k]) > min_distance
        return out
    wide = int(c.max() - c.min()) + 2 * far + 1
    disc = [i * wide + j for i in range(-far, far + 1) for j in range(-far, far + 1) if np.hypot(i, j) <= min_distance]
    dead, out = set(), []
    for i, p in zip(order.tolist(), ((r - r.min()) * wide + c - c.min()).tolist(), strict=True):
        if p not in dead:
            out.append(i)
            dead.update([p + d for d in disc])
    return out


def of_each(group: np.ndarray, n_columns: int, one: Callable[[slice], list]) -> tuple[np.ndarray, list]:
    """A ``Reader``'s result from a function of each image's rows."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    found = [one(slice(lo, hi)) for lo, hi in zip(first, np.r_[first[1:], len(group)], strict=True)]
    again = np.repeat(group[first], [len(f[0]) for f in found])
    return again, [np.concatenate([f[k] for f in found]) for k in range(n_columns)] if found else []


def peaks(heat: DataFrame | Targets, threshold: float = 0.4, min_distance: float = 2.5, width: int = 128, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, rank, row, col, v: greedy non-maximum suppression of each heatmap. Only cells above the threshold enter the group."""

    def read(group, row, col, v):
        if not len(v):
            return group, [group, row.astype(np.int32), col.astype(np.int32), v]

        def one(part):
            r, c, x = row[part], col[part], v[part]
            at = suppressed(r, c, x, threshold, min_distance, width)
            return [np.arange(1, len(at) + 1), r[at].astype(np.int32), c[at].astype(np.int32), x[at]]

        return of_each(group, 4, one)

    return each(heat, read, "rank bigint, row int, col int, v double", threshold, image)


def heat_stats(heat: DataFrame | Targets, cells: int, image: Sequence[str] = IMAGE) -> DataFrame:
    """Per image: max, cells above 0.2, 0.4 and 0.6, place of the maximum (the first by row and col), mean, population std, min, over all ``cells`` of the grid: absent ones are 0."""

    def read(group, row, col, v):
        if not len(v):
            return group, [v, group, group, group, row, col, v, v, v]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        n = np.diff(np.r_[first, len(v)])
        most = np.maximum.reduceat(v, first)
        at = np.flatnonzero(v == np.repeat(most, n))
        top = at[np.searchsorted(at, first)]
        mean = np.add.reduceat(v, first) / cells
        std = np.sqrt(np.maximum(np.add.reduceat(v * v, first) / cells - mean * mean, 0.0))
        least = np.where(n < cells, 0.0, np.minimum.reduceat(v, first))
        return group[first], [most, *[np.add.reduceat((v > t).astype(np.int64), first) for t in (0.2, 0.4, 0.6)], row[top], col[top], mean, std, least]

    return each(heat, read, f"max double, above_2 bigint, above_4 bigint, above_6 bigint, {_cell_kinds(heat)}, mean double, std double, min double", None, image)


def cosine_pairs(heat: DataFrame, images: DataFrame, image: str = "image_id") -> DataFrame:
    """a, b, cosine for the pairs of a stated, small set of images, a < b: products meet in an equality join on the cell."""
    h = heat.join(images.select(image), image, "left_semi")
    norm = h.groupBy(image).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    a = h.select(F.col(image).alias("a"), "row", "col", F.col("v").alias("va"))
    b = h.select(F.col(image).alias("b"), "row", "col", F.col("v").alias("vb"))
    dot = a.join(b, (a.row == b.row) & (a.col == b.col) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("d"))
    na, nb = norm.select(F.col(image).alias("a"), F.col("n").alias("na")), norm.select(F.col(image).alias("b"), F.col("n").alias("nb"))
    return dot.join(na, "a").join(nb, "b").select("a", "b", (F.col("d") / (F.col("na") * F.col("nb"))).alias("cosine"))


def otsu(pixels: DataFrame, image: Sequence[str] = IMAGE) -> DataFrame:
    """image, threshold: the gray value that parts the histogram with the largest between-class variance, the least of equal ones.

    ``pixels`` has image, gray (0 to 255) and n, so at most 256 rows per image reach the running sums.
    """
    n = pixels.groupBy(*image, "gray").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*image)
    below = w.orderBy("gray").rowsBetween(Window.unboundedPreceding, 0)
    s = n.withColumn("w0", F.sum("n").over(below)).withColumn("s0", F.sum(F.col("n") * F.col("gray")).over(below)).withColumn("w", F.sum("n").over(w)).withColumn("s", F.sum(F.col("n") * F.col("gray")).over(w))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(F.lit(0.0))
    best = s.withColumn("b", between).groupBy(*image).agg(F.max_by("gray", F.struct(F.col("b"), (-F.col("gray")).alias("g"))).alias("threshold"))
    return best
