"""The driver's queries: every operator applied to tables that the driver has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.functions.lattice import motif_text
from lineloom.operators import generate, graph, heatmap, matching, motifs, multiset, selection, stats
from lineloom.sources.traces import event_traces

Query = Callable[[SparkSession, str], DataFrame]
_ENDS = graph.ENDS
#: Window radii of the selectors that grow; the selectors' own greatest radius is 3.
RADII = (1, 2, 3)


def _trace(spark, d):
    return event_traces(spark, d)


def _visit(spark, d):
    return graph.visits(_trace(spark, d))


def _strand(spark, d):
    return graph.strands(_visit(spark, d))


def _edge(spark, d):
    return graph.edges(_strand(spark, d))


def _node(spark, d):
    return graph.nodes(_visit(spark, d))


def _made(spark, d):
    """Strands that stamping every interior window at its own place makes: overlaps add up."""
    made = motifs.stamp(_window(spark, d), _node(spark, d))
    return made.withColumnRenamed("n", "mult")


def _window(spark, d):
    return motifs.windows(_node(spark, d), _edge(spark, d), 1)


def _canon(spark, d):
    return motifs.canonical_windows(_window(spark, d))


def _places(spark, d, side):
    """image_id, idx, x, y of every row of lineitem: places by part and supplier, and the same places moved a little."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    x, y = F.col("l_partkey") * 7 % 900, F.col("l_suppkey") * 13 % 900
    if side == "truth":
        x, y = x + F.col("l_orderkey") % 41, y + F.col("l_linenumber") * 7 % 23
    return t.select(F.expr("l_orderkey div 40").alias("image_id"), (x * 10_000 + y).cast("bigint").alias("idx"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def _points(spark, d, side):
    """Two sets of points per image."""
    return _places(spark, d, side).distinct()


def _pr(spark, d):
    return matching.match_metrics(_points(spark, d, "det"), _points(spark, d, "truth"), 30.0)


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), "p_name")


def _selected(select, radii=(1,)):
    def query(spark, d):
        frame = selection.task_frame(_node(spark, d), _edge(spark, d), radii)
        return selection.grouped(frame, select)

    return query


def trace_summary(spark, d):
    return graph.trace_summary(_trace(spark, d))


def degree_parity(spark, d):
    return graph.degrees(_node(spark, d), _edge(spark, d)).withColumn("odd", F.col("degree") % 2 == 1)


def path_length(spark, d):
    return graph.path_lengths(_trace(spark, d)).withColumn("path_length", F.round("path_length", 6))


def canonical_motifs(spark, d):
    return _canon(spark, d).select("pattern_id", "x", "y", motif_text(F.col("canon")).alias("canon"), "transform")


def local_windows(spark, d):
    return _window(spark, d).select("pattern_id", "x", "y", F.size("motif").cast("bigint").alias("n_edges"), motif_text(F.col("motif")).alias("motif"))


def dominant_motif(spark, d):
    return motifs.dominant(_window(spark, d)).withColumn("motif", motif_text(F.col("motif")))


def dominant_motif_symmetric(spark, d):
    return motifs.dominant(_canon(spark, d), "canon").withColumn("canon", motif_text(F.col("canon")))


def candidate_groups(spark, d):
    g = motifs.candidate_groups(_canon(spark, d))
    return g.select("pattern_id", motif_text(F.col("canon")).alias("canon"), "n_points", F.array_min("points")["x"].alias("first_x"))


def stamped_edges(spark, d):
    w = _canon(spark, d).withColumn("canon", motif_text(F.col("canon")))
    return motifs.stamp(w, _node(spark, d), by=("canon",))


def duplicates_source(spark, d):
    e = _made(spark, d)
    ends = e.select("pattern_id", F.col("ax").alias("x"), F.col("ay").alias("y")).union(e.select("pattern_id", "bx", "by")).distinct()
    found = multiset.duplicates_source(ends, e, _node(spark, d), _edge(spark, d))
    return found.withColumn("duplicates", F.when(F.col("duplicates").isNull(), "other layout").when(F.col("duplicates"), "yes").otherwise("no"))


def motif_library(spark, d):
    w = _canon(spark, d).where(F.size("canon") > 0)
    return w.groupBy("canon").agg(F.min("pattern_id").alias("first_pattern"), F.countDistinct("pattern_id").alias("n_patterns")).select(motif_text(F.col("canon")).alias("motif"), "first_pattern", "n_patterns")


def validity_report(spark, d):
    return graph.validity(_node(spark, d), _edge(spark, d))


def single_stroke_gate(spark, d):
    return validity_report(spark, d).groupBy("single_stroke").agg(F.count("*").alias("n_patterns"), F.sum("components").alias("n_components"))


def tolerance_match(spark, d):
    return matching.nearest(_points(spark, d, "det"), _points(spark, d, "truth"), 30.0).withColumn("dist", F.round("dist", 9))


def detector_summary(spark, d):
    m = _pr(spark, d).agg(F.count("*").alias("n_images"), F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"))
    return m.select("n_images", F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round("f", 9).alias("mean_f1"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 9).alias("f1_of_means"))


def nearest_spacing(spark, d):
    return matching.dot_radius(_points(spark, d, "det"), 100.0).withColumns({c: F.round(c, 9) for c in ("spacing", "radius")})


def symmetry_error(spark, d):
    return matching.symmetry_errors(_trace(spark, d), ("pattern_id",)).withColumns({c: F.round(c, 6) for c in matching.SYMMETRIES})


def fp_rate(spark, d):
    return stats.false_positive_rate(_pr(spark, d))


def summary_stats(spark, d):
    n = _edge(spark, d).groupBy("pattern_id").agg(F.sum("mult").alias("n"))
    return stats.describe(n, "n").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def cumulative_recall(spark, d):
    e = _edge(spark, d)
    placed = matching.rank_within(e, [F.desc("mult"), *map(F.col, _ENDS)], ("pattern_id",)).select("pattern_id", "rank", F.col("mult").alias("n"))
    return stats.cumulative_recall(placed, e.groupBy("pattern_id").agg(F.sum("mult").alias("n_total")), ("pattern_id",))


def failure_reasons(spark, d):
    why = stats.failure_reason(F.col("n_det"), F.col("n_truth"), F.col("f1"), F.lit(None).cast("string"))
    return _pr(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("n_images"))


def dotted_classifier(spark, d):
    n = graph.degrees(_node(spark, d), _edge(spark, d)).groupBy("pattern_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") % 2 == 1).alias("n_odd"))
    return n.withColumn("dotted", F.col("n_odd") / F.col("n_nodes") <= 0.5)


def _heat(spark, d):
    # a cell out of reach is over 4 cells away: exp(-16 / 0.72) < 3e-10, below the rounding
    return heatmap.Targets(_places(spark, d, "det"), 64, 900.0, sigma=0.6, reach=4)  # repeated points change no heatmap


def gaussian_heatmap(spark, d):
    return _heat(spark, d).cells().withColumn("v", F.round("v", 6))


def description_length(spark, d):
    g = motifs.candidate_groups(_canon(spark, d)).groupBy("pattern_id").agg(F.sum(4 * F.size("canon") + 3 * F.col("n_points")).alias("cost"))
    e = _edge(spark, d).groupBy("pattern_id").agg(F.sum("mult").alias("n_strands"))
    size = (F.coalesce("cost", F.lit(0)) + 4 * F.col("n_strands")).cast("bigint")
    out = e.join(g, "pattern_id", "left").select("pattern_id", "n_strands", size.alias("size"))
    return out.withColumn("ratio", motifs.compression_ratio(F.col("n_strands"), F.col("size")))


def reconstruct(spark, d):
    r = generate.reconstruct(_edge(spark, d), _made(spark, d))
    return r.select("pattern_id", *_ENDS, (F.col("kept") + F.col("deficit")).alias("mult")).where("mult > 0")


def novel_place(spark, d):
    """Each pattern's own chosen motifs on its own dots, as if these were a new layout."""

    def select(task):
        chosen, *_ = selection.budgeted_select(task, radius=1, max_radius=1, parity=True)
        inside = {p for p, _, _ in task.seen.get(1, ())}
        out: dict[tuple[str, str], selection.Choice] = {}
        for p, c, t in selection.novel_place([c.canon for c in chosen], task.dots, inside):
            out.setdefault((c, t), selection.Choice(c, [], 1, {})).points.append((p, t))
        return list(out.values()), {}

    return _selected(select)(spark, d).where("kind = 'stamp'").drop("bx", "by", "n")


QUERIES: dict[str, Query] = {
    "trace_summary": trace_summary,
    "dot_visits": _visit,
    "edge_multiplicity": _edge,
    "repeated_pairs": lambda s, d: _edge(s, d).groupBy("pattern_id").agg(F.count_if(F.col("mult") > 1).alias("n_repeated"), F.max("mult").alias("most")),
    "degree_parity": degree_parity,
    "path_length": path_length,
    "parallel_ordinal": lambda s, d: graph.parallel_ordinals(_strand(s, d)),
    "interior_points": lambda s, d: motifs.interior(_node(s, d), 1),
    "local_windows": local_windows,
    "canonical_motifs": canonical_motifs,
    "dominant_motif": dominant_motif,
    "dominant_motif_symmetric": dominant_motif_symmetric,
    "candidate_groups": candidate_groups,
    "stamped_edges": stamped_edges,
    "reconcile_pairs": lambda s, d: generate.reconstruct(_edge(s, d), _made(s, d)),
    "compare_to_source": lambda s, d: generate.compare_to_source(generate.reconstruct(_edge(s, d), _made(s, d))),
    "multiset_intersect": lambda s, d: multiset.intersect(_edge(s, d), _made(s, d)),
    "multiset_minus": lambda s, d: multiset.minus(_edge(s, d), _made(s, d)),
    "multiset_plus": lambda s, d: multiset.plus(_edge(s, d), _made(s, d)),
    "union_pairs": lambda s, d: multiset.union_pairs(_edge(s, d), _made(s, d)),
    "self_consistency": lambda s, d: multiset.self_consistency(_edge(s, d), _made(s, d)),
    "duplicates_source": duplicates_source,
    "edge_recall": lambda s, d: multiset.edge_recall(_edge(s, d), _made(s, d)),
    "motif_library": motif_library,
    "connected_components": lambda s, d: graph.component_roots(_node(s, d), _edge(s, d)),
    "validity_report": validity_report,
    "single_stroke_gate": single_stroke_gate,
    "tolerance_match": tolerance_match,
    "precision_recall": _pr,
    "detector_summary": detector_summary,
    "agreement": lambda s, d: matching.agreement(_points(s, d, "det"), _points(s, d, "truth"), 30.0),
    "one_to_one_match": lambda s, d: matching.one_to_one(_points(s, d, "det"), _points(s, d, "truth"), 30.0),
    "nearest_spacing": nearest_spacing,
    "symmetry_error": symmetry_error,
    "fp_rate": fp_rate,
    "summary_stats": summary_stats,
    "top10_path_length": lambda s, d: stats.top(_trace(s, d).groupBy("pattern_id").agg(F.count("*").alias("n_points")), F.desc("n_points"), "pattern_id"),
    "cumulative_recall": cumulative_recall,
    "archive_search": lambda s, d: stats.search(_parts(s, d), " 12 "),
    "pagination": lambda s, d: stats.page(_parts(s, d), "id", 3),
    "archive_neighbours": lambda s, d: stats.neighbours(_parts(s, d).select("id"), "id").fillna(-1),
    "trace_ends": lambda s, d: stats.ends(_trace(s, d), ("pattern_id",), "step"),
    "failure_reasons": failure_reasons,
    "dotted_classifier": dotted_classifier,
    "gaussian_heatmap": gaussian_heatmap,
    "local_maxima": lambda s, d: heatmap.local_maxima(_heat(s, d)).withColumn("v", F.round("v", 6)),
    "nms_peaks": lambda s, d: heatmap.peaks(_heat(s, d)),
    "description_length": description_length,
    "reconstruct": reconstruct,
    "greedy_cover": _selected(lambda t: selection.greedy_cover(t)),
    "mdl_select": _selected(lambda t: selection.mdl_select(t), RADII),
    "multiplicity_select": _selected(lambda t: selection.budgeted_select(t), RADII),
    "eulerian_select": _selected(lambda t: selection.budgeted_select(t, parity=True), RADII),
    "novel_place": novel_place,
    "euler_trail": lambda s, d: generate.euler_trails(_node(s, d), _edge(s, d)),
    "diagnose": lambda s, d: generate.diagnoses(_node(s, d), _edge(s, d)),
}
