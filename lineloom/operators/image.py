"""Drawings in gray images to lattice graphs: binarise, deskew, find dots, fit the lattice, follow strokes.

Plain numpy on one image at a time; :func:`graphs` runs it over a DataFrame of decoded images in Arrow batches, so images spread
over the cluster. Distances are exact Euclidean (lower envelope of parabolas), strokes are thinned by two alternating passes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the detector.
MIN_INK, PEAK_SHARE, SPACING_SHARE, HUB_REACH = 10, 0.65, 1.8, 1.3
DIVISORS = (1.0, math.sqrt(2), 2.0, 2 * math.sqrt(2))


def otsu_threshold(gray: np.ndarray) -> int:
    """The gray value that parts the histogram with the largest between-class variance."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0.0)
    return int(np.argmax(between))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p, float)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def skew(mask: np.ndarray) -> float:
    """Degrees by which the smallest rectangle around the ink is off the nearest of 0 and 45 degrees; 0 for little ink."""
    ys, xs = np.nonzero(mask)
    if len(xs) < MIN_INK:
        return 0.0
    hull = _hull(np.stack([xs, ys], axis=1))
    if len(hull) < 3:
        return 0.0
    edges = np.roll(hull, -1, axis=0) - hull
    best = (math.inf, 0.0)
    for a in np.arctan2(edges[:, 1], edges[:, 0]):
        c, s = math.cos(a), math.sin(a)
        u, v = hull @ [c, s], hull @ [-s, c]
        best = min(best, ((u.max() - u.min()) * (v.max() - v.min()), math.degrees(a)))
    return (best[1] + 22.5) % 45 - 22.5


def rotate(mask: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the centre, nearest pixel, same size."""
    if not degrees:
        return mask
    h, w = mask.shape
    y, x = np.mgrid[:h, :w]
    (cx, cy), a = ((w - 1) / 2, (h - 1) / 2), math.radians(degrees)
    sx = np.rint((x - cx) * math.cos(a) - (y - cy) * math.sin(a) + cx).astype(int)
    sy = np.rint((x - cx) * math.sin(a) + (y - cy) * math.cos(a) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, mask[sy.clip(0, h - 1), sx.clip(0, w - 1)], 0).astype(mask.dtype)


def rotate_points(points: np.ndarray, degrees: float, shape: tuple[int, int], back: bool = False) -> np.ndarray:
    """Points of the image as they lie after :func:`rotate`, or back in the original frame."""
    (cx, cy), a = ((shape[1] - 1) / 2, (shape[0] - 1) / 2), math.radians(degrees if back else -degrees)
    d = np.asarray(points, float).reshape(-1, 2) - [cx, cy]
    return np.stack([d[:, 0] * math.cos(a) - d[:, 1] * math.sin(a) + cx, d[:, 0] * math.sin(a) + d[:, 1] * math.cos(a) + cy], axis=1)


def preprocess(gray: np.ndarray) -> tuple[np.ndarray, float]:
    """Ink mask after deskewing, and the rotation that was undone."""
    mask = (gray <= otsu_threshold(gray)).astype(np.uint8) if gray.size and gray.min() < gray.max() else np.zeros(gray.shape, np.uint8)
    turn = skew(mask)
    return rotate(mask, turn), turn


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every ink pixel to the nearest other pixel; what lies outside counts as paper."""
    pad = np.pad(mask.astype(bool), 1)
    far = float(sum(pad.shape)) ** 2
    rows = np.where(pad, far, 0.0)

    def lower(f: np.ndarray) -> np.ndarray:
        n, v, z, k = len(f), np.zeros(len(f), int), np.zeros(len(f) + 1), 0
        z[0], z[1] = -math.inf, math.inf
        for q in range(1, n):
            while True:
                s = ((f[q] + q * q) - (f[v[k]] + v[k] * v[k])) / (2 * q - 2 * v[k])
                if s > z[k]:
                    break
                k -= 1
            k += 1
            v[k], z[k], z[k + 1] = q, s, math.inf
        at = v[np.searchsorted(z[1 : k + 1], np.arange(n), side="left")]
        return (np.arange(n) - at) ** 2 + f[at]

    cols = np.apply_along_axis(lower, 0, rows)
    return np.sqrt(np.apply_along_axis(lower, 1, cols))[1:-1, 1:-1]


def dots(mask: np.ndarray) -> tuple[np.ndarray, float]:
    """(x, y) of dots, the thick spots of the ink, and their radius."""
    d = distance(mask) if mask.any() else np.zeros(mask.shape)
    r = float(d.max()) if d.size else 0.0
    if r < 1:
        return np.zeros((0, 2)), r
    apart = max(3, round(SPACING_SHARE * r))
    ys, xs = np.nonzero(d >= PEAK_SHARE * r)
    order = np.lexsort((xs, ys, -d[ys, xs]))
    kept: list[tuple[int, int]] = []
    for i in order:
        if all(max(abs(xs[i] - x), abs(ys[i] - y)) > apart for x, y in kept):
            kept.append((int(xs[i]), int(ys[i])))
    return np.array(sorted(kept, key=lambda p: (p[1], p[0])), float), r


def fit_lattice(points: np.ndarray) -> np.ndarray:
    """Whole lattice places of dots, index by index: the first spacing without collisions wins, else the one of least residual."""
    p = np.asarray(points, float).reshape(-1, 2)
    if len(p) < 3:
        return np.zeros((0, 2), int)
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + np.eye(len(p)) * 1e18
    spacing, best = float(np.median(gap.min(1))), None
    for divisor in DIVISORS:
        step = spacing / divisor
        place = np.rint((p - p.min(0)) / step)
        for _ in range(6):  # affine refits
            a = np.concatenate([p, np.ones((len(p), 1))], axis=1)
            m, *_ = np.linalg.lstsq(a, place, rcond=None)
            new = np.rint(a @ m)
            if (new == place).all():
                break
            place = new
        place = (place - place.min(0)).astype(int)
        if len(set(map(tuple, place.tolist()))) == len(p):
            return place
        residual = float(np.abs(a @ m - np.rint(a @ m)).mean())
        if best is None or residual < best[0]:
            best = (residual, place)
    return best[1]


def thin(mask: np.ndarray) -> np.ndarray:
    """One pixel wide strokes, by the two alternating passes of Zhang and Suen."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        before = m.sum()
        for first in (True, False):
            n = [m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:], m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]]
            around = sum(x.astype(int) for x in n)
            turns = sum((~a & b).astype(int) for a, b in zip(n, n[1:] + n[:1], strict=True))
            gates = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6]) if first else ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
            m[1:-1, 1:-1] &= ~(m[1:-1, 1:-1] & (around >= 2) & (around <= 6) & (turns == 1) & gates)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers, from 1, of the 8-connected parts of a mask."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], todo = n, [(y, x)]
        while todo:
            cy, cx = todo.pop()
            for v in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                for u in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                    if mask[v, u] and not out[v, u]:
                        out[v, u] = n
                        todo.append((v, u))
    return out


def strokes(mask: np.ndarray, points: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Pairs of dots that strokes join: a stroke between two dots is an edge, one that touches more joins all their pairs."""
    if len(points) < 2:
        return []
    line = thin(mask)
    ys, xs = np.nonzero(line)
    if not len(xs):
        return []
    d = np.sqrt((xs[:, None] - points[None, :, 0]) ** 2 + (ys[:, None] - points[None, :, 1]) ** 2)
    hub = np.where(d.min(1) <= HUB_REACH * radius, d.argmin(1), -1)
    where = np.full(mask.shape, -1)
    where[ys, xs] = hub
    part = label(line & (where < 0))
    touched: dict[int, set[int]] = {}
    for y, x in zip(*np.nonzero(part), strict=True):
        near = where[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2]
        touched.setdefault(int(part[y, x]), set()).update(int(h) for h in near[near >= 0])
    return sorted((a, b) for hubs in touched.values() for a in hubs for b in hubs if a < b)


class ContractError(ValueError):
    """A detector's result does not conform."""


def assert_conforms(pixels: np.ndarray, places: np.ndarray, radius: float) -> None:
    """Places are absent or one per dot and distinct; the radius is not negative."""
    if len(places) not in (0, len(pixels)):
        raise ContractError("places must be absent or match the dots")
    if len(set(map(tuple, np.asarray(places).tolist()))) != len(places):
        raise ContractError("two dots share a place")
    if radius < 0 or not math.isfinite(radius):
        raise ContractError("the radius must be a number of at least 0")


def analyse(gray: np.ndarray, detector=dots) -> dict:
    """Dots (in the original frame and on the lattice) and edges of one image. ``detector`` maps an ink mask to dots and radius."""
    mask, turn = preprocess(gray)
    found, radius = detector(mask)
    places = fit_lattice(found)
    assert_conforms(found, places, radius)
    return {"dots": rotate_points(found, turn, mask.shape, back=True), "places": places, "edges": strokes(mask, found, radius) if len(places) else [], "radius": radius, "rotation": turn}


def graphs(images: DataFrame, detector=dots) -> DataFrame:
    """kind, image_id, idx, x, y, lx, ly, other: a row per dot (``dot``), per edge (``edge``: idx and other) and per failure (``error``).

    ``images`` has image_id, height, width and gray (binary, a byte per pixel). An image that fails gives its error and stops nothing.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    a = analyse(np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width), detector)
                except Exception as e:  # one bad image is a row, not a failed job
                    rows.append((r.image_id, "error", None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                placed = a["places"] if len(a["places"]) else [(None, None)] * len(a["dots"])
                rows += [(r.image_id, "dot", i, float(x), float(y), *(None if v is None else int(v) for v in p), None, None) for i, ((x, y), p) in enumerate(zip(a["dots"], placed, strict=True))]
                rows += [(r.image_id, "edge", i, None, None, None, None, j, None) for i, j in a["edges"]]
            yield pd.DataFrame(rows, columns=["image_id", "kind", "idx", "x", "y", "lx", "ly", "other", "error"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "height", "width", "gray").mapInPandas(run, f"image_id {kind}, kind string, idx bigint, x double, y double, lx bigint, ly bigint, other bigint, error string")


def gray_stats(gray: np.ndarray) -> tuple[float, float, float]:
    """Mean, standard deviation and share of ink."""
    return float(gray.mean()), float(gray.std()), float((gray <= otsu_threshold(gray)).mean())
