"""Reports over many patterns: what a selection explains, how modes compare, what was generated, how drawings were recovered.

All are plans over the tables of the other operators; rates are rounded half to even, as the published figures are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.lattice import motif_of_text
from lineloom.operators import generate, graph, motifs, multiset
from lineloom.operators.graph import KEY
from lineloom.operators.motifs import EDGE_COST, PLACEMENT_COST


def share(part: Column, whole: Column, empty: float | None) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))


def reconciliation_metrics(recon: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: distinct pairs of source and candidate, pairs with too many strands, share of source pairs with exactly their strands; odd vertices of the candidate.

    ``recon`` is the table of :func:`generate.reconstruct`. Without source pairs both shares are 1.
    """
    t, p = F.col("target"), F.col("produced")
    out = recon.groupBy(*key).agg(
        F.count_if(t > 0).alias("source_pairs"), F.count_if(p > 0).alias("covered_pairs"), F.count_if(p > t).alias("over_explained_pairs"), F.count_if((t > 0) & (p == t)).alias("agreeing_pairs"),
    )
    ends = recon.select(*key, F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("v"), "produced")
    odd = ends.groupBy(*key, "v").agg(F.sum("produced").alias("d")).groupBy(*key).agg(F.count_if(F.col("d") % 2 == 1).alias("n_odd"))
    return out.join(odd, list(key)).withColumn("recall", F.bround(share(F.col("covered_pairs"), F.col("source_pairs"), 1.0), 4)).withColumn("agreement", F.bround(share(F.col("agreeing_pairs"), F.col("source_pairs"), 1.0), 4))


def motif_only(source: DataFrame, node: DataFrame, made: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: what stamps alone give on the source's dots: share of source pairs found (1 without any), components, validity."""
    recall = node.select(*key).distinct().join(multiset.edge_recall(source, made, key).select(*key, "recall"), list(key), "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))
    return recall.join(graph.validity(node, made, key).select(*key, "components", F.col("single_stroke").alias("is_valid")), list(key))


def pair_scores(truth: DataFrame, found: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern of either: precision and recall of pairs, distinct and by strands (an excess strand is wrong, a missing one not found).

    Nothing to find is a recall of 1, nothing found a precision of 0.
    """
    both = generate.reconstruct(truth, found, key)
    t, p, k = (F.sum(c) for c in ("target", "produced", "kept"))
    nt, np_, nk = (F.count_if(F.col(c) > 0) for c in ("target", "produced", "kept"))
    out = both.groupBy(*key).agg(nt.alias("n_truth"), np_.alias("n_found"), t.alias("truth_strands"), p.alias("found_strands"), nk.alias("_nk"), k.alias("_k"))
    c = F.col
    scores = {"precision": share(c("_nk"), c("n_found"), 0.0), "recall": share(c("_nk"), c("n_truth"), 1.0), "strand_precision": share(c("_k"), c("found_strands"), 0.0), "strand_recall": share(c("_k"), c("truth_strands"), 1.0)}
    return out.withColumns({n: F.bround(s, 4) for n, s in scores.items()}).drop("_nk", "_k")


def selection_report(result: DataFrame, edge: DataFrame, key: Sequence[str] = KEY, max_radius: int = 3) -> DataFrame:
    """Per pattern of ``edge``: motifs chosen (in all and by radius), pairs left with strands to explain, recall by pairs, size of the description and its ratio.

    ``result`` is the long table of :func:`selection.grouped`. A motif that comes again pays its rule again.
    """
    stamps = result.where("kind = 'stamp'").groupBy(*key, "rank", "radius", "motif").agg(F.count("*").alias("points"))
    length = F.when(F.col("motif") == "", 0).otherwise(F.size(F.split("motif", ";")))
    chosen = stamps.groupBy(*key).agg(
        F.count("*").alias("n_motifs"), *[F.count_if(F.col("radius") == r).alias(f"radius_{r}") for r in range(1, max_radius + 1)], F.sum(EDGE_COST * length + PLACEMENT_COST * F.col("points")).alias("_cost"),
    )
    left = result.where("kind = 'residual'").groupBy(*key).agg(F.count("*").alias("n_residual"), F.sum("n").alias("_left"))
    total = edge.groupBy(*key).agg(F.count("*").alias("n_edges"), F.sum("mult").alias("n_strands"))
    out = total.join(chosen, list(key), "left").join(left, list(key), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_motifs", "n_residual", "_cost", "_left", *[f"radius_{r}" for r in range(1, max_radius + 1)])})
    size = F.col("_cost") + EDGE_COST * F.col("_left")
    out = out.withColumn("recall", F.bround(1 - F.col("n_residual") / F.col("n_edges"), 4)).withColumn("fully_covered", F.col("n_residual") == 0)
    return out.withColumn("size", size).withColumn("ratio", F.bround(motifs.compression_ratio(F.col("n_strands"), size), 4)).drop("_cost", "_left")


def against_baseline(report: DataFrame, baseline: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``report`` with the baseline's recall and ratio and whether they are beaten; patterns without a baseline have nulls."""
    b = baseline.select(*key, F.col("recall").alias("base_recall"), F.col("ratio").alias("base_ratio"))
    out = report.join(b, list(key), "left")
    return out.withColumn("beats_recall", F.col("recall") > F.col("base_recall")).withColumn("beats_ratio", F.col("ratio") > F.col("base_ratio"))


def placements(result: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The stamps of a selection as placements: key, x, y, motif (array), transform, rank, radius."""
    return result.where("kind = 'stamp'").select(*key, "x", "y", motif_of_text(F.col("motif")).alias("motif"), "transform", "rank", "radius")


def mode_report(results: dict[str, DataFrame], node: DataFrame, edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per pattern and mode: what its selection explains when it is stamped, and the description's ratio."""
    out = None
    for mode, result in results.items():
        made = generate.candidate_graph(placements(result, key), node, key)
        metrics = reconciliation_metrics(generate.reconstruct(edge, made, key), key)
        valid = graph.validity(node, made, key).select(*key, "components", F.col("single_stroke").alias("is_valid"))
        one = metrics.join(valid, list(key)).join(selection_report(result, edge, key).select(*key, "n_motifs", "ratio"), list(key)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def mode_summary(report: DataFrame, by: str = "mode") -> DataFrame:
    """Per mode: patterns, averages of recall, over-explained pairs, agreement and odd vertices, valid patterns."""
    valid = [F.count_if("is_valid").alias("n_valid")] if "is_valid" in report.columns else []
    return report.groupBy(by).agg(F.count("*").alias("n_patterns"), *[F.avg(c).alias(f"avg_{c}") for c in ("recall", "over_explained_pairs", "agreement", "n_odd")], *valid)


def novel_report(result: DataFrame, node: DataFrame, edge: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per layout: what was generated on its dots: pairs, strands, placements, motifs used, connected, valid, share of the most frequent window up to symmetry, whether the source came out again."""
    placed = placements(result, key)
    made = generate.candidate_graph(placed, node, key)
    n = node.groupBy(*key).agg(F.count("*").alias("n_dots"))
    used = placed.groupBy(*key).agg(F.count("*").alias("n_placements"), F.countDistinct("motif").alias("n_motifs"))
    pairs = made.groupBy(*key).agg(F.count("*").alias("n_edges"), F.sum("mult").alias("n_strands"))
    valid = graph.validity(node, made, key)
    top = motifs.dominant(motifs.canonical_windows(motifs.windows(node, made, 1, key)), "canon", key).select(*key, F.bround("coverage", 4).alias("symmetry_coverage"))
    same = multiset.self_consistency(made, edge, key)
    out = n.join(used, list(key), "left").join(pairs, list(key), "left").join(valid, list(key), "left").join(top, list(key), "left").join(same, list(key), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_placements", "n_motifs", "n_edges", "n_strands")})
    return out.withColumn("connected", F.col("largest_covers_all") & (F.col("components") == 1)).withColumnsRenamed({"single_stroke": "is_valid", "consistent": "duplicates_source"})


def correction_report(diagnosis: DataFrame, node: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Over all patterns: passed and failed; of the failed ones the average and largest number and cost of corrections, cost per node, and how many are in parts."""
    d = diagnosis.join(node.groupBy(*key).agg(F.count("*").alias("n_nodes")), list(key))
    bad = ~F.col("is_valid")
    only = lambda c: F.when(bad, c)
    return d.agg(
        F.count("*").alias("n_patterns"), F.count_if(bad).alias("n_failed"), F.avg(only(F.col("n_corrections"))).alias("avg_corrections"), F.max(only(F.col("n_corrections"))).alias("max_corrections"),
        F.avg(only(F.col("cost"))).alias("avg_cost"), F.max(only(F.col("cost"))).alias("max_cost"), F.avg(only(F.col("cost") / F.col("n_nodes"))).alias("avg_cost_per_node"), F.count_if(bad & (F.col("nodes_outside") > 0)).alias("n_in_parts"),
    )


def validity_of_all(trace: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Validity of every pattern of a trace; a pattern that visits no dot has no component and is valid in no sense."""
    visit = graph.visits(trace, key)
    found = graph.validity(graph.nodes(visit, key), graph.edges(graph.strands(visit, key), key), key)
    out = trace.select(*key).distinct().join(found, list(key), "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_eulerian_circuit", "has_eulerian_path", "largest_covers_all", "single_stroke")}
    return out.withColumns({"components": F.coalesce("components", F.lit(0).cast("bigint")), **flags})


def invariants(trace: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per pattern: whether every step has both coordinates, and whether the ends of its strands are its dots (a single dot has no strand)."""
    visit = graph.visits(trace, key)
    node, strand = graph.nodes(visit, key), graph.strands(visit, key)
    ends = strand.select(*key, F.col("ax").alias("x"), F.col("ay").alias("y")).union(strand.select(*key, "bx", "by")).distinct()
    both = node.withColumn("_n", F.lit(1)).join(ends.withColumn("_e", F.lit(1)), [*key, "x", "y"], "full_outer")
    same = both.groupBy(*key).agg(F.count("*").alias("n_dots"), F.bool_and(F.col("_n").isNotNull() & F.col("_e").isNotNull()).alias("_same"))
    whole = trace.groupBy(*key).agg((F.count("x") == F.count("y")).alias("aligned"))
    out = whole.join(same, list(key), "left")
    return out.select(*key, "aligned", (F.coalesce(F.col("_same") | (F.col("n_dots") == 1), F.lit(True))).alias("nodes_are_dots"))


def table_text(report: DataFrame, order: str, most: int = 200) -> str:
    """The first ``most`` rows of a report as text with aligned columns, for printing."""
    rows = [[str(v) for v in r] for r in report.orderBy(order).limit(most).collect()]
    widths = [max(map(len, c)) for c in zip(report.columns, *rows, strict=True)]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in [report.columns, *rows])

