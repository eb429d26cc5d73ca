"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Unit vectors are projected on many random directions. Two vectors collide on a projection when one lies in the window
centred on the other; the window is a fixed multiple of the spread that a pair just at the cosine limit has. A pair is verified in double
precision when it collides on at least as many projections as a pair at the limit reaches with the calibrated recall
(binomial tail), which unrelated pairs hardly ever do.

Which pairs are counted at all depends on how many vectors a label has. A few thousand are compared as they are, sorted on a first projection and
cut into runs, of which only those within a wide window of each other meet. For more, several projections are cut into cells and banded
into one key, and vectors meet where a key is equal; keys come in as many tables as keep the recall. Projections per key grow with the logarithm of the
label's size and tables with a power of about 0.22, so that work grows with about the 1.22th power. A pair that meets in several tables counts in the first.
A key that holds many vectors is cut into runs as a whole label is.

A task returns sums per vector and a spanning forest of its links, never the links of a group of copies. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import components, stored

#: Cells are so many spreads wide: a pair at the limit shares one with ``_KEPT``, an unrelated pair in directions of equal variance (mean cosine 0) with ``met``.
_CELL = 6.0
#: Relative costs of counting a pair and of bringing a vector to a table, as measured on one core (nanoseconds).
_PAIR_COST, _ROW_COST = 15.0, 4000.0
_MOST_KEYED = 30


def _same_cell(width: float) -> float:
    """Chance that two normal values share a randomly placed cell of ``width`` standard deviations of their difference."""
    return math.erf(width / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


_KEPT = _same_cell(_CELL)


def tables_for(per_key: int, recall: float) -> int:
    """Tables of keys from ``per_key`` projections each in which a pair at the limit meets at least once with ``recall``."""
    return 1 if not per_key else math.ceil(math.log(1 - recall) / math.log(1 - _KEPT**per_key))


def bands(size: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections per key, tables) of least work for a label of ``size`` vectors; (0, 1) compares them all."""
    met = _same_cell(_CELL * math.sqrt(1 - cosine))  # unrelated unit vectors differ by the square root of 2, a pair at the limit by that of 2 - 2 cosine
    cost = lambda k: tables_for(k, recall) * (size * met**k / 2 * _PAIR_COST + _ROW_COST)
    best = min(range(_MOST_KEYED + 1), key=cost)
    return best, tables_for(best, recall)


def calibrate(cosine: float, dim: int, projections: int, width: float, recall: float) -> tuple[float, int]:
    """(half window, least count): a pair at ``cosine`` reaches the count on random unit directions with ``recall``."""
    spread = math.sqrt(2 * (1 - cosine) / dim)
    p = math.erf(width / math.sqrt(2))
    tail, least = 0.0, projections
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        least = k
        if tail >= recall:
            break
    return width * spread, least


def directions(dim: int, projections: int, seed: int = 42) -> np.ndarray:
    """Random unit directions, one per row."""
    d = np.random.default_rng(seed + dim).standard_normal((projections, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys_of(v: np.ndarray, per_key: int, tables: int, cosine: float, seed: int) -> list[int]:
    """A unit vector's key in every table: a hash of the cells of ``per_key`` projections."""
    if not per_key:
        return [0]
    rng = np.random.default_rng((seed, 7, len(v), per_key))
    d = rng.standard_normal((tables * per_key, len(v)))
    width = _CELL * math.sqrt(2 * (1 - cosine) / len(v))
    at = (d / np.linalg.norm(d, axis=1, keepdims=True)) @ v / width + rng.random(tables * per_key)
    cells = np.floor(at).astype(np.int64).reshape(tables, per_key)
    mixed = np.zeros(tables, np.uint64)
    for j in range(per_key):
        mixed = (mixed ^ cells[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64).tolist()


def collisions(q: np.ndarray, o: np.ndarray, half: float) -> np.ndarray:
    """How many projections each row of ``q`` shares with each row of ``o`` within query-centred windows of ``half`` to either side."""
    a, b = np.ascontiguousarray(q.T, np.float32), np.ascontiguousarray(o.T, np.float32)
    counts = np.zeros((len(q), len(o)), np.uint8 if len(a) < 256 else np.uint16)
    gap, hit = np.empty(counts.shape, np.float32), np.empty(counts.shape, bool)
    for x, y in zip(a, b, strict=True):
        np.subtract(x[:, None], y[None], out=gap)
        np.abs(gap, out=gap)
        np.less_equal(gap, np.float32(half), out=hit)
        np.add(counts, hit.view(np.uint8), out=counts)
    return counts


def links(x_q, p_q, x_o, p_o, cosine: float, half: float, least: int, same: bool, chunk: int = 64):
    """Yields (rows of q, rows of o) of verified pairs, chunk by chunk; for one run met with itself each pair once."""
    for at in range(0, len(x_q), chunk):
        first = at if same else 0
        i, j = np.nonzero(collisions(p_q[at : at + chunk], p_o[first:], half) >= least)
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = np.einsum("nd,nd->n", x_q[a], x_o[b]) >= cosine
            yield a[ok], b[ok]


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Pairs that span the components of ``pairs`` over n nodes, as (root, node)."""
    root = np.arange(n)
    while len(pairs):
        np.minimum.at(root, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], root[pairs[:, 0]])
        while (root != root[root]).any():
            root = root[root]
        ends = root[pairs]
        pairs = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
        # roots that a pair still ties go below the lower one in the next round
    node = np.flatnonzero(root != np.arange(n))
    return np.stack([root[node], node], axis=1)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, projections: int = 32, width: float = 1.2, recall: float = 0.999, lead_width: float = 3.5, run_size: int = 1024, seed: int = 42, per_key: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links (rows linked directly), component_id (smallest vec_id reachable), kept.

    Rows link at a cosine of at least ``cosine`` under equal, non-null labels and equal dimension. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing: no links, a component of their own, kept. Rows that repeat
    an id or a vector are rows of their own and link with each other. A row with a null id links, but has a null component
    unless a linked row has an id. An empty table gives an empty result; other columns are not read. ``per_key`` sets the projections
    per key, which else follow from each label's size.
    """
    x = F.col("x")
    number = "double" if "double" in vectors.schema[vector_col].dataType.simpleString() else "float"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{number}>").alias("x"), F.col(label_col).cast("string").alias("label"))
    usable = F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("x", F.transform(x, lambda c: c + F.lit(0).cast(number)))  # no negative zeros, which hash apart
    rows = rows.withColumn("h1", F.xxhash64("label", "x")).withColumn("h2", F.xxhash64(F.lit(1), "label", "x"))
    good = rows.where("ok")
    sizes = stored(good.groupBy("label", F.size("x").alias("dim")).agg(F.count("*").alias("size")), "sizes")
    classes = good.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    classes = classes.withColumn("dim", F.size("x")).join(sizes, ["label", "dim"]).withColumn("cid", F.monotonically_increasing_id())

    def project(batches):
        seen = {}
        for batch in batches:
            lead, keys = [], []
            for v, size in zip(batch.column("x"), batch.column("size").to_pylist(), strict=True):
                v = unit(np.array(v.as_py(), float)[None])[0]
                if (len(v), size) not in seen:
                    k = bands(size, cosine, recall) if per_key is None else (per_key, tables_for(per_key, recall))
                    seen[len(v), size] = (directions(len(v), 1, seed)[0], *k)
                d, k, tables = seen[len(v), size]
                lead.append(float(d @ v))
                keys.append(keys_of(v, k, tables, cosine, seed))
            got = [batch.column(c) for c in ("cid", "label", "dim", "x", "rep", "n", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*got, pa.array(lead, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], ["cid", "label", "dim", "x", "rep", "n", "h1", "h2", "lead", "keys"])

    schema = f"cid bigint, label string, dim int, x array<{number}>, rep bigint, n bigint, h1 bigint, h2 bigint, lead double, keys array<bigint>"
    placed = stored(classes.select("cid", "label", "dim", "x", "rep", "n", "h1", "h2", "size").mapInArrow(project, schema), "classes")
    group = ["label", "dim", "t", "key"]
    posts = placed.select("label", "dim", "cid", "lead", F.posexplode("keys").alias("t", "key"))
    # runs: groups of more than run_size vectors are cut at approximate quantiles of the first projection
    held = stored(posts.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1"), "groups")
    largest = held.agg(F.max("size")).first()[0] or 1
    grid = max(2, -(-largest // run_size))
    n_runs = F.ceil(F.col("size") / run_size).cast("int")
    big = held.where(F.col("size") > run_size)
    quantiles = posts.join(big.select(*group), group).groupBy(*group).agg(F.percentile_approx("lead", [k / grid for k in range(1, grid)], 10 * grid + 1000).alias("q"))
    at = F.transform(F.sequence(F.lit(1), n_runs - 1), lambda i: F.get("q", F.greatest(F.lit(1), F.floor(i * grid / n_runs)).cast("int") - 1))
    cuts = stored(big.join(quantiles, group).select(*group, at.alias("cuts")), "cuts")
    dealt = posts.join(held.select(*group), group).join(cuts, group, "left").withColumn("run", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("lead"))), F.lit(0))).drop("cuts")
    dealt = stored(dealt.select(*group, "run", "cid", "lead"), "dealt")
    runs = stored(dealt.groupBy(*group, "run").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi")), "runs")
    reach = lead_width * F.sqrt(F.lit(2 * (1 - cosine)) / F.col("dim"))
    other = runs.select(*group, F.col("run").alias("run_b"), F.col("lo").alias("lo_b"))
    meets = runs.join(other, group).where((F.col("run") <= F.col("run_b")) & (F.col("lo_b") - F.col("hi") <= reach)).select(*group, F.col("run").alias("a"), F.col("run_b").alias("b"))
    calls = meets.select(*group, "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("run", F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")))
    tiles = dealt.join(calls, [*group, "run"]).select(*group, "a", "b", "side", "cid").join(placed.select("cid", "n", "x", "keys"), "cid")

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        dim, side, t = tile.column("dim")[0].as_py(), tile.column("side").to_numpy(), tile.column("t")[0].as_py()
        half, least = calibrate(cosine, dim, projections, width, recall)
        cid, n = tile.column("cid").to_numpy(), tile.column("n").to_numpy()
        u = unit(tile.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
        keys = tile.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)[:, :t]
        p = (u @ directions(dim, projections, seed).T).astype(np.float32)
        q = np.flatnonzero(side == 0)
        same = tile.column("a")[0].as_py() == tile.column("b")[0].as_py()
        o = q if same else np.flatnonzero(side == 1)
        linked, kept = np.zeros(len(cid), np.int64), np.zeros((0, 2), np.int64)
        for i, j in links(u[q], p[q], u[o], p[o], cosine, half, least, same):
            i, j = q[i], o[j]
            fresh = ~(keys[i] == keys[j]).any(axis=1)  # pairs that met in an earlier table are counted there
            i, j = i[fresh], j[fresh]
            np.add.at(linked, i, n[j])
            np.add.at(linked, j, n[i])
            kept = forest(len(cid), np.concatenate([kept, np.stack([i, j], axis=1)]))
        some = np.flatnonzero(linked)
        a, b = np.concatenate([cid[some], cid[kept[:, 0]]]), np.concatenate([cid[some], cid[kept[:, 1]]])
        return pa.table({"a": a, "b": b, "links": np.concatenate([linked[some], np.zeros(len(kept), np.int64)])})

    out = stored(tiles.groupBy(*group, "a", "b").applyInArrow(compare, "a bigint, b bigint, links bigint"), "links")
    linked = out.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    found = components(out.where("a <> b").select("a", "b"))
    reps = placed.select("cid", "rep", "n", "h1", "h2").join(found, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    least_id = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = stored(reps.join(least_id, "root").join(linked, "cid", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "told")
    ours = rows.where("ok").select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ours.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
