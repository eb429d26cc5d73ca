"""The driver's queries of the report tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions.lattice import motif_text
from lineloom.operators import generate, graph, heatmap, matching, motifs, multiset, populations, reports, selection, stats
from lineloom.plans import queries as q

SWEEP = {"threshold": (0.2, 0.3, 0.4, 0.5, 0.6), "min_distance": (1.0, 1.5, 2.0, 2.5, 3.0)}


def _recon(s, d):
    return generate.reconstruct(q._edge(s, d), q._made(s, d))


def _metrics(s, d):
    return reports.reconciliation_metrics(_recon(s, d))


def _density(s, d):
    return q._points(s, d, "det").groupBy("image_id").agg(F.count("*").alias("n_points"))


def _mode(parity):
    return q._selected(lambda t: selection.budgeted_select(t, max_radius=1, parity=parity))


_cover = q._selected(lambda t: selection.mdl_select(t, max_radius=1))


def interior_by_radius(s, d):
    node, out = q._node(s, d), None
    for r in (1, 2, 3):
        one = motifs.interior(node, r).groupBy("pattern_id").agg(F.count("*").alias("n_points")).withColumn("radius", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def mode_averages(s, d):
    m = reports.mode_summary(_metrics(s, d).withColumn("mode", F.col("pattern_id") % 3))
    return m.withColumns({c: F.round(c, 9) for c in m.columns if c.startswith("avg_")})


def failed_only(s, d):
    v = graph.validity(q._node(s, d), q._made(s, d))
    bad = ~F.col("single_stroke")
    return v.agg(F.count("*").alias("n_patterns"), F.count_if(bad).alias("n_failed"), F.avg(F.when(bad, F.col("components"))).alias("avg_components"), F.max(F.when(bad, F.col("components"))).alias("max_components"), F.avg(bad.cast("double")).alias("share"))


def dotted_families(s, d):
    n = graph.degrees(q._node(s, d), q._edge(s, d)).groupBy("pattern_id").agg((F.count_if(F.col("degree") % 2 == 1) / F.count("*") <= 0.10).alias("dotted"))
    return n.groupBy((F.col("pattern_id") % 5).alias("family")).agg(F.count("*").alias("n_patterns"), F.count_if("dotted").alias("n_dotted"))


def separability(s, d):
    out = populations.separability(q._points(s, d, "det"), (32, 64, 128), 900.0, 1.2, 100.0)
    return out.withColumns({c: F.round(c, 9) for c in ("median", "within_2_sigma", "within_3_sigma")})


def heat_statistics(s, d):
    return heatmap.heat_stats(q._heat(s, d), 64 * 64).withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max")})


def no_dot_false_positives(s, d):
    out = populations.no_dot_false_positives(q._heat(s, d), q._places(s, d, "det"), 64)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("n_images", "n_false")})


def populations_(s, d):
    kind = populations.population(F.col("image_id"), (0, 50, 100), (3, 10, 17, 24))
    return q._pr(s, d).groupBy(kind.alias("population")).agg(F.count("*").alias("n_images"), F.sum("n_det").alias("n_dots"))


def low_contrast(s, d):
    m = q._pr(s, d).withColumn("detector", F.col("image_id") % 2)
    out = populations.compared(m, ["detector"], F.col("image_id") * 37 % 256 < 100)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if "precision" in c or "recall" in c})


def baseline_lookup(s, d):
    report = q.description_length(s, d).select("pattern_id", F.lit(0.9).alias("recall"), F.bround("ratio", 4).alias("ratio"))
    base = report.where("pattern_id % 2 = 0").select("pattern_id", F.lit(0.95).alias("recall"), F.lit(0.5).alias("ratio"))
    return reports.against_baseline(report, base)


def side_by_side(s, d):
    a = q._points(s, d, "det").withColumn("error", F.lit(None).cast("string"))
    b = q._points(s, d, "truth").withColumn("error", F.lit(None).cast("string"))
    failed = b.where("image_id % 11 = 0").select("image_id").distinct().select("image_id", F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit("timeout").alias("error"))
    return populations.side_by_side(a, b.where("image_id % 11 <> 0").unionByName(failed), 30.0)


def library_ranks(s, d):
    w = q._canon(s, d).where(F.size("canon") > 0)
    placed = matching.rank_within(w, [F.col("x"), F.col("y")], ("pattern_id",)).withColumnRenamed("motif", "window").withColumn("motif", motif_text(F.col("canon")))
    return multiset.motif_library(placed.select("pattern_id", "motif", "rank"))


def match_distances(s, d):
    out = populations.distance_stats(q._points(s, d, "det"), q._points(s, d, "truth"), 30.0)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "median", "least", "most")})


def top10_symmetry(s, d):
    e, out = q.symmetry_error(s, d), None
    for name in matching.SYMMETRIES:
        one = stats.top(e.select("pattern_id", F.col(name).alias("error")), F.asc("error"), "pattern_id").withColumn("measure", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def pixel_frame(s, d):
    return populations.pixel_frame(q._node(s, d), ("pattern_id",)).withColumns({c: F.round(c, 6) for c in ("px", "py")})


def mode_report(s, d):
    results = {"A": _cover(s, d), "B": _mode(False)(s, d), "C": _mode(True)(s, d)}
    return reports.mode_report(results, q._node(s, d), q._edge(s, d))


QUERIES: dict[str, q.Query] = {
    "reconciliation_metrics": _metrics,
    "motif_only": lambda s, d: reports.motif_only(q._edge(s, d), q._node(s, d), q._made(s, d)),
    "pair_scores": lambda s, d: reports.pair_scores(q._edge(s, d), q._made(s, d)),
    "interior_by_radius": interior_by_radius,
    "mode_averages": mode_averages,
    "failed_only": failed_only,
    "dotted_families": dotted_families,
    "separability": separability,
    "heat_statistics": heat_statistics,
    "no_dot_false_positives": no_dot_false_positives,
    "distribution_check": lambda s, d: populations.distribution(_density(s, d), "n_points"),
    "density_survey": lambda s, d: populations.density_survey(_density(s, d), "n_points"),
    "representatives": lambda s, d: populations.representatives(_density(s, d), "n_points", "image_id", 160),
    "populations": populations_,
    "low_contrast": low_contrast,
    "point_lookup": lambda s, d: stats.lookup(q._parts(s, d), 7),
    "featured": lambda s, d: stats.featured(q._parts(s, d), (3, 17, 42)),
    "invariants": lambda s, d: reports.invariants(q._trace(s, d)),
    "validity_of_all": lambda s, d: reports.validity_of_all(q._trace(s, d)),
    "parameter_grid": lambda s, d: populations.grid(s, **SWEEP),
    "baseline_lookup": baseline_lookup,
    "side_by_side": side_by_side,
    "shared_members": lambda s, d: populations.shared_members(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_linenumber") % 3).cast("bigint").alias("part"), "l_partkey"), "part", "l_partkey"),
    "library_ranks": library_ranks,
    "match_distances": match_distances,
    "top10_symmetry": top10_symmetry,
    "pixel_frame": pixel_frame,
    "dominant_by_symmetry": lambda s, d: motifs.analyse_symmetry(q._node(s, d), q._edge(s, d)).withColumn("canon", motif_text(F.col("canon"))),
    "peak_sweep": lambda s, d: populations.peak_sweep(q._heat(s, d), q._points(s, d, "det"), 900 / 64, SWEEP["threshold"], SWEEP["min_distance"], 30.0, 64),
    "selection_report": lambda s, d: reports.selection_report(q._selected(lambda t: selection.mdl_select(t), q.RADII)(s, d), q._edge(s, d)),
    "mode_report": mode_report,
    "novel_report": lambda s, d: reports.novel_report(q.novel_place(s, d).withColumn("kind", F.lit("stamp")), q._node(s, d), q._edge(s, d)),
    "correction_report": lambda s, d: reports.correction_report(generate.diagnoses(q._node(s, d), q._made(s, d)), q._node(s, d)),
    "structure": lambda s, d: generate.structure(reports.placements(_mode(True)(s, d)), q._node(s, d))["diagnosis"],
}
