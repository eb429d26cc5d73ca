"""The eight symmetries of the square lattice and motifs as SQL expressions.

A motif is an array of edges ``[ax, ay, bx, by]`` relative to a centre, endpoints in order within an edge and edges in order
within the motif; parallel strands repeat an edge. Arrays of ints compare and group in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (x, y) -> (p x + q y, r x + s y), in the order in which transforms are tried.
D4: dict[str, tuple[int, int, int, int]] = {
    "identity": (1, 0, 0, 1),
    "rot90": (0, -1, 1, 0),
    "rot180": (-1, 0, 0, -1),
    "rot270": (0, 1, -1, 0),
    "reflect_x": (1, 0, 0, -1),
    "reflect_y": (-1, 0, 0, 1),
    "reflect_diag": (0, 1, 1, 0),
    "reflect_antidiag": (0, -1, -1, 0),
}
MOTIF = "array<array<int>>"


def ordered_edge(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """An edge with its smaller endpoint first."""
    swap = (bx < ax) | ((bx == ax) & (by < ay))
    return F.when(swap, F.array(bx, by, ax, ay)).otherwise(F.array(ax, ay, bx, by))


def apply_transform(name: str, motif: Column) -> Column:
    """The image of a motif under a named transform, in canonical order."""
    p, q, r, s = D4[name]

    def edge(e: Column) -> Column:
        ax, ay, bx, by = (F.get(e, i) for i in range(4))
        return ordered_edge(ax * p + ay * q, ax * r + ay * s, bx * p + by * q, bx * r + by * s)

    return F.array_sort(F.transform(motif, edge))


def canonical_motif(motif: Column) -> Column:
    """The least of a motif's eight images: equal for motifs that differ by a rotation or a reflection."""
    return F.array_min(F.array(*[apply_transform(name, motif) for name in D4]))


def find_transform(canon: Column, window: Column) -> Column:
    """Name of the first transform that takes ``canon`` to ``window``; null if none does."""
    return F.coalesce(*[F.when(apply_transform(name, canon) == window, F.lit(name)) for name in D4])


def motif_text(motif: Column) -> Column:
    """``ax,ay>bx,by`` of every edge, parted by semicolons."""
    return F.array_join(F.transform(motif, lambda e: F.format_string("%d,%d>%d,%d", *[F.get(e, i) for i in range(4)])), ";")


def motif_of_text(text: Column) -> Column:
    """The motif that :func:`motif_text` wrote."""
    edges = F.transform(F.split(text, ";"), lambda e: F.transform(F.split(e, "[,>]"), lambda v: v.cast("int")))
    return F.when(text == "", F.array().cast(MOTIF)).otherwise(edges)


# the same on plain tuples, for the grouped Python operators

Edge = tuple[int, int, int, int]


def ordered(ax: int, ay: int, bx: int, by: int) -> Edge:
    return (ax, ay, bx, by) if (ax, ay) <= (bx, by) else (bx, by, ax, ay)


def transformed(name: str, motif: tuple[Edge, ...]) -> tuple[Edge, ...]:
    p, q, r, s = D4[name]
    return tuple(sorted(ordered(p * ax + q * ay, r * ax + s * ay, p * bx + q * by, r * bx + s * by) for ax, ay, bx, by in motif))


def canonical(motif: tuple[Edge, ...]) -> tuple[Edge, ...]:
    return min(transformed(name, motif) for name in D4)


def first_transform(canon: tuple[Edge, ...], window: tuple[Edge, ...]) -> str | None:
    return next((name for name in D4 if transformed(name, canon) == window), None)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 when both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
