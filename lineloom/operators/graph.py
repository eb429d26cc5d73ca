"""Traces to multigraphs: visits, strands, edges with multiplicity, degrees, components, validity.

Tables carry the key columns of their pattern. ``trace`` has key, step, x, y; ``visit`` key, seq, x, y (ints); ``edge`` key, ax, ay,
bx, by (smaller endpoint first) and mult. Edges keep their multiplicity everywhere: parity depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("pattern_id",)
ENDS = ("ax", "ay", "bx", "by")


def dots_only(trace: DataFrame) -> DataFrame:
    """Points of a trace that lie on the lattice, as ints; rows with a null coordinate are left out."""
    on = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y"))
    return trace.where(on).withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})


def visits(trace: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The sequence of dots that a trace visits, consecutive repeats collapsed; seq starts at 1."""
    w = Window.partitionBy(*key).orderBy("step")
    here, last = F.struct("x", "y"), F.lag(F.struct("x", "y")).over(w)
    kept = dots_only(trace).withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_last") != here))
    return kept.select(*key, F.row_number().over(w).cast("bigint").alias("seq"), "x", "y")


def strands(visit: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row for each step between successive visits: key, seq, ax, ay, bx, by."""
    w = Window.partitionBy(*key).orderBy("seq")
    to = visit.withColumn("_to", F.lead(F.struct("x", "y")).over(w)).where("_to is not null")
    a, b = F.least(F.struct("x", "y"), "_to"), F.greatest(F.struct("x", "y"), "_to")
    return to.select(*key, "seq", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def edges(strand: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Edges with the number of their strands."""
    return strand.groupBy(*key, *ENDS).agg(F.count("*").alias("mult"))


def nodes(visit: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return visit.select(*key, "x", "y").distinct()


def parallel_ordinals(strand: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Strands with their place, from 0, among the parallel ones."""
    w = Window.partitionBy(*key, *ENDS).orderBy("seq")
    return strand.withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint"))


def degrees(node: DataFrame, edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Degree of every node: parallel strands count each, a self-loop counts two, isolated nodes have 0."""
    ends = edge.select(*key, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"), "mult")
    deg = ends.groupBy(*key, F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.sum("mult").alias("degree"))
    return node.join(deg, [*key, "x", "y"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def component_roots(node: DataFrame, edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, x, y, root_x, root_y: the least node of each node's component.

    One pattern is one group of a grouped function (the largest known has some thousand nodes); patterns are independent and
    spread over the cluster. Only distinct edges enter the group.
    """
    links = edge.select(*key, *ENDS).distinct().unionByName(node.select(*key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by")))

    def roots(g: pd.DataFrame) -> pd.DataFrame:
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def top(p):
            while up[p] != p:
                up[p] = up[up[p]]
                p = up[p]
            return p

        for ax, ay, bx, by in g[list(ENDS)].itertuples(index=False):
            a, b = (ax, ay), (bx, by)
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = sorted((top(a), top(b)))
            up[b] = a
        rows = [(*p, *top(p)) for p in sorted(up)]
        out = pd.DataFrame(rows, columns=["x", "y", "root_x", "root_y"])
        for k in reversed(key):
            out.insert(0, k, g[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {node.schema[k].dataType.simpleString()}" for k in key)
    return links.groupBy(*key).applyInPandas(roots, f"{kinds}, x int, y int, root_x int, root_y int")


def validity(node: DataFrame, edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: components, and on the largest one whether an Eulerian circuit or path exists; covers_all; single_stroke.

    The largest component has most nodes, of equal ones the one with the least node. A circuit counts as a path. Patterns without nodes
    are not in ``node`` and get no row here; :func:`reports.validity_of_all` starts from the trace and fills them.
    """
    deg = degrees(node, edge, key)
    root = component_roots(node, edge, key)
    per = deg.join(root, [*key, "x", "y"]).groupBy(*key, "root_x", "root_y").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") % 2 == 1).alias("n_odd"))
    most = F.max_by(F.struct("n_nodes", "n_odd"), F.struct("n_nodes", (-F.col("root_x")).alias("rx"), (-F.col("root_y")).alias("ry")))
    out = per.groupBy(*key).agg(F.count("*").alias("components"), F.sum("n_nodes").alias("n_nodes"), most.alias("m"))
    circuit, path, covers = F.col("m.n_odd") == 0, F.col("m.n_odd").isin(0, 2), F.col("m.n_nodes") == F.col("n_nodes")
    return out.select(*key, "components", circuit.alias("is_eulerian_circuit"), path.alias("has_eulerian_path"), covers.alias("largest_covers_all"), (covers & path).alias("single_stroke"))


def trace_summary(trace: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: points, dots, strands, distinct edges, double edges, odd vertices, bounding box, closed (first point = last)."""
    visit = visits(trace, key)
    edge = edges(strands(visit, key), key)
    deg = degrees(nodes(visit, key), edge, key)
    whole = trace.groupBy(*key).agg(
        F.count("*").alias("n_points"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)],
        (F.min_by(F.struct("x", "y"), "step") == F.max_by(F.struct("x", "y"), "step")).alias("closed"),
    )
    d = deg.groupBy(*key).agg(F.count("*").alias("n_dots"), F.count_if(F.col("degree") % 2 == 1).alias("n_odd"))
    e = edge.groupBy(*key).agg(F.sum("mult").alias("n_strands"), F.count("*").alias("n_edges"), F.count_if(F.col("mult") > 1).alias("n_repeated"))
    out = whole.join(d, list(key), "left").join(e, list(key), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_dots", "n_odd", "n_strands", "n_edges", "n_repeated")})


def path_lengths(trace: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: length of the whole trace, gap between its ends, width and height."""
    w = Window.partitionBy(*key).orderBy("step")
    dx, dy = (F.col(c) - F.lag(c).over(w) for c in ("x", "y"))
    stepped = trace.withColumn("_d", F.sqrt(dx * dx + dy * dy))
    first, last = F.min_by(F.struct("x", "y"), "step"), F.max_by(F.struct("x", "y"), "step")
    gx, gy = first["x"] - last["x"], first["y"] - last["y"]
    return stepped.groupBy(*key).agg(
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("path_length"), F.sqrt(gx * gx + gy * gy).alias("closure_gap"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height")
    )
