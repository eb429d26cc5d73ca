"""DuckDB SQL of the report tier's queries."""

from __future__ import annotations

from lineloom.plans import sql
from lineloom.plans.sql import build, text

sql._CTE.update(
    {
        "recon": sql._RECON,
        "mfin": "SELECT pattern_id, ax AS x, ay AS y, mult FROM made UNION ALL SELECT pattern_id, bx, by, mult FROM made",
        "mdeg": "SELECT pattern_id, x, y, coalesce(sum(mult), 0)::BIGINT AS degree FROM node LEFT JOIN mfin USING (pattern_id, x, y) GROUP BY ALL",
        "metrics0": "SELECT pattern_id, count_if(target > 0) AS source_pairs, count_if(produced > 0) AS covered_pairs, count_if(produced > target) AS over_explained_pairs, count_if(target > 0 AND produced = target) AS agreeing_pairs FROM recon GROUP BY 1",
        "modd": "SELECT pattern_id, count_if(d % 2 = 1) AS n_odd FROM (SELECT pattern_id, x, y, sum(produced) AS d FROM (SELECT pattern_id, ax AS x, ay AS y, produced FROM recon UNION ALL SELECT pattern_id, bx, by, produced FROM recon) GROUP BY ALL) GROUP BY 1",
        "metrics": "SELECT *, round_even(covered_pairs / source_pairs, 4) AS recall, round_even(agreeing_pairs / source_pairs, 4) AS agreement FROM metrics0 JOIN modd USING (pattern_id)",
        "density": "SELECT image_id, count(*) AS n_points FROM det GROUP BY 1",
        "heat": "SELECT image_id, r AS row, c AS col, max(exp(-((x / 900.0::DOUBLE * 64 - c) ** 2 + (y / 900.0::DOUBLE * 64 - r) ** 2) / (2 * 0.6::DOUBLE * 0.6::DOUBLE))) AS v FROM (SELECT image_id, x, y, unnest(range(greatest(floor(x / 900.0::DOUBLE * 64)::INT - 4, 0), least(floor(x / 900.0::DOUBLE * 64)::INT + 5, 64))) AS c FROM det), LATERAL (SELECT unnest(range(greatest(floor(y / 900.0::DOUBLE * 64)::INT - 4, 0), least(floor(y / 900.0::DOUBLE * 64)::INT + 5, 64))) AS r) GROUP BY ALL",
        "around": "SELECT image_id, row + i AS row, col + j AS col, max(v) AS m FROM heat, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) GROUP BY ALL",
        "maxima": "SELECT image_id, row, col, v FROM heat JOIN around USING (image_id, row, col) WHERE v >= 0.2 AND v >= m",
        "next": "SELECT d.image_id, d.idx, min(sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y))) AS dist FROM det d LEFT JOIN det t ON d.image_id = t.image_id AND d.idx <> t.idx GROUP BY 1, 2",
        "centred": "SELECT pattern_id, step, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM trace WINDOW w AS (PARTITION BY pattern_id)",
        "turned": "SELECT a.pattern_id, a.step, s.name, min(sqrt((s.p * a.x - b.x) ** 2 + (s.q * a.y - b.y) ** 2)) AS m FROM centred a JOIN centred b ON a.pattern_id = b.pattern_id, (VALUES ('vertical', -1, 1), ('horizontal', 1, -1), ('rotation180', -1, -1)) s(name, p, q) GROUP BY ALL",
        "symmetry": "SELECT pattern_id, name, round(avg(m), 6) AS error FROM turned GROUP BY 1, 2",
    }
)
sql._NEEDS.update(
    {
        "recon": ["edge", "made"], "mfin": ["made"], "mdeg": ["node", "mfin"], "metrics0": ["recon"], "modd": ["recon"], "metrics": ["metrics0", "modd"], "density": ["det"], "heat": ["det"], "around": ["heat"], "maxima": ["around"], "next": ["det"], "centred": ["trace"], "turned": ["centred"], "symmetry": ["turned"],
    }
)

_MADE = ", ".join((sql._LINK.replace("FROM edge", "FROM made"), sql._REACH, sql._ROOT, sql._PART.replace("JOIN degree", "JOIN mdeg"), sql._BEST))
_AVG = "round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall"
_LOW = "(image_id * 37 % 256 < 100)"

ORACLE: dict[str, str] = {
    "reconciliation_metrics": build("SELECT * FROM metrics", "metrics"),
    "motif_only": build(f"SELECT n.pattern_id, coalesce(r.recall, 1.0)::DOUBLE AS recall, v.components, v.single_stroke AS is_valid FROM (SELECT DISTINCT pattern_id FROM node) n LEFT JOIN (SELECT pattern_id, count(o.mult) / count(*) AS recall FROM edge LEFT JOIN made o USING (pattern_id, ax, ay, bx, by) GROUP BY 1) r USING (pattern_id) JOIN ({sql._VALIDITY}) v USING (pattern_id)", "node", "edge", "made", "mdeg", recursive=_MADE),
    "pair_scores": build(
        "SELECT pattern_id, n_truth, n_found, truth_strands, found_strands, round_even(CASE WHEN n_found > 0 THEN nk / n_found ELSE 0.0 END, 4)::DOUBLE AS precision, round_even(CASE WHEN n_truth > 0 THEN nk / n_truth ELSE 1.0 END, 4)::DOUBLE AS recall, round_even(CASE WHEN found_strands > 0 THEN k / found_strands ELSE 0.0 END, 4)::DOUBLE AS strand_precision, round_even(CASE WHEN truth_strands > 0 THEN k / truth_strands ELSE 1.0 END, 4)::DOUBLE AS strand_recall FROM "
        "(SELECT pattern_id, count_if(target > 0) AS n_truth, count_if(produced > 0) AS n_found, sum(target)::BIGINT AS truth_strands, sum(produced)::BIGINT AS found_strands, count_if(least(target, produced) > 0) AS nk, sum(least(target, produced))::BIGINT AS k FROM recon GROUP BY 1)",
        "recon",
    ),
    "interior_by_radius": build("SELECT pattern_id, r::INT AS radius, count(*) AS n_points FROM node JOIN box USING (pattern_id), (VALUES (1), (2), (3)) t(r) WHERE x BETWEEN x0 + r AND x1 - r AND y BETWEEN y0 + r AND y1 - r GROUP BY ALL", "box"),
    "mode_averages": build("SELECT pattern_id % 3 AS mode, count(*) AS n_patterns, round(avg(recall), 9) AS avg_recall, round(avg(over_explained_pairs), 9) AS avg_over_explained_pairs, round(avg(agreement), 9) AS avg_agreement, round(avg(n_odd), 9) AS avg_n_odd FROM metrics GROUP BY 1", "metrics"),
    "failed_only": build(f"SELECT count(*) AS n_patterns, count(*) FILTER (WHERE NOT single_stroke) AS n_failed, avg(components) FILTER (WHERE NOT single_stroke) AS avg_components, max(components) FILTER (WHERE NOT single_stroke) AS max_components, avg((NOT single_stroke)::INT::DOUBLE) AS share FROM ({sql._VALIDITY})", "node", "made", "mdeg", recursive=_MADE),
    "dotted_families": build("SELECT pattern_id % 5 AS family, count(*) AS n_patterns, count_if(dotted) AS n_dotted FROM (SELECT pattern_id, count(*) FILTER (WHERE degree % 2 = 1) / count(*) <= 0.10 AS dotted FROM degree GROUP BY 1) GROUP BY 1", "degree"),
    "separability": build(
        "SELECT n.image_id, n.resolution, n_dots, n_cells, n_dots - n_cells AS n_lost, median, within_2_sigma, within_3_sigma FROM (SELECT image_id, r::INT AS resolution, count(*) AS n_dots, count(DISTINCT (round_even(x * (r / 900.0::DOUBLE), 0), round_even(y * (r / 900.0::DOUBLE), 0))) AS n_cells FROM det, (VALUES (32), (64), (128)) t(r) GROUP BY 1, 2) n "
        "JOIN (SELECT image_id, r::INT AS resolution, round(median(dist * (r / 900.0::DOUBLE)), 9) AS median, round(avg((dist * (r / 900.0::DOUBLE) < 2.4::DOUBLE)::INT::DOUBLE), 9) AS within_2_sigma, round(avg((dist * (r / 900.0::DOUBLE) < 3 * 1.2::DOUBLE)::INT::DOUBLE), 9) AS within_3_sigma FROM next, (VALUES (32), (64), (128)) t(r) GROUP BY 1, 2) f USING (image_id, resolution)",
        "next",
    ),
    "heat_statistics": build(
        "SELECT s.image_id, round(mean, 6) AS mean, round(sqrt(greatest(q / 4096 - mean * mean, 0)), 6) AS std, round(CASE WHEN n < 4096 THEN 0.0 ELSE least_v END, 6)::DOUBLE AS min, round(most, 6) AS max, above_2, above_4, above_6, t.row, t.col FROM (SELECT image_id, sum(v) / 4096 AS mean, sum(v * v) AS q, count(*) AS n, min(v) AS least_v, max(v) AS most, count_if(v > 0.2) AS above_2, count_if(v > 0.4) AS above_4, count_if(v > 0.6) AS above_6 FROM heat GROUP BY 1) s "
        "JOIN (SELECT image_id, row, col FROM heat QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, row, col) = 1) t USING (image_id)",
        "heat",
    ),
    "no_dot_false_positives": build(
        "SELECT count(*) AS n_images, count_if(n > 0) AS n_false, round(avg(n), 9) AS mean_peaks, round(avg(col / 64), 9) AS mean_x, round(avg(row / 64), 9) AS mean_y, round(stddev_pop(col / 64), 9) AS std_x, round(stddev_pop(row / 64), 9) AS std_y FROM (SELECT d.image_id, coalesce(p.n, 0) AS n, coalesce(t.row, 0) AS row, coalesce(t.col, 0) AS col FROM density d LEFT JOIN (SELECT image_id, count(*) AS n FROM maxima GROUP BY 1) p USING (image_id) "
        "LEFT JOIN (SELECT image_id, row, col FROM heat QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, row, col) = 1) t USING (image_id))",
        "density", "maxima",
    ),
    "distribution_check": build("SELECT min(n_points) AS least, max(n_points) AS most, median(n_points) AS median FROM density", "density"),
    "density_survey": build("SELECT count(*) AS n_images, min(n_points) AS least, max(n_points) AS most, count(DISTINCT n_points) AS n_values FROM density", "density"),
    "representatives": build(
        "SELECT image_id, n_points, string_agg(role, '+' ORDER BY role) AS roles FROM (SELECT image_id, n_points, 'lowest' AS role FROM low0 WHERE p = 1 UNION ALL SELECT image_id, n_points, 'highest' FROM low0 WHERE p = total UNION ALL SELECT image_id, n_points, 'middle' FROM low0 WHERE p = 1 + (CASE WHEN n_low > 0 THEN n_low ELSE total END) // 2) GROUP BY ALL".replace("FROM low0", "FROM (SELECT *, row_number() OVER (ORDER BY n_points, image_id) AS p, count(*) OVER () AS total, count(*) FILTER (WHERE n_points < 160) OVER () AS n_low FROM density)"),
        "density",
    ),
    "populations": build("SELECT CASE WHEN image_id IN (0, 50, 100) THEN 'excluded' WHEN image_id IN (3, 10, 17, 24) THEN 'in_scope' ELSE 'no_dots' END AS population, count(*) AS n_images, sum(n_det)::BIGINT AS n_dots FROM pr GROUP BY 1", "pr"),
    "low_contrast": build(f"SELECT image_id % 2 AS detector, count(*) AS n_images, {_AVG}, count(*) FILTER (WHERE {_LOW}) AS low_n_images, round(avg(precision) FILTER (WHERE {_LOW}), 9) AS low_precision, round(avg(recall) FILTER (WHERE {_LOW}), 9) AS low_recall FROM pr GROUP BY 1", "pr"),
    "point_lookup": "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey = 7",
    "featured": "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey IN (3, 17, 42)",
    "invariants": build(
        "SELECT t.pattern_id, t.aligned, coalesce(s.same OR s.n_dots = 1, true) AS nodes_are_dots FROM (SELECT pattern_id, count(x) = count(y) AS aligned FROM trace GROUP BY 1) t LEFT JOIN (SELECT pattern_id, count(*) AS n_dots, bool_and(n IS NOT NULL AND e IS NOT NULL) AS same FROM (SELECT *, 1 AS n FROM node) FULL JOIN (SELECT DISTINCT pattern_id, x, y, 1 AS e FROM fin) USING (pattern_id, x, y) GROUP BY 1) s USING (pattern_id)",
        "trace", "node", "fin",
    ),
    "validity_of_all": build(
        f"SELECT t.pattern_id, coalesce(components, 0) AS components, coalesce(is_eulerian_circuit, false) AS is_eulerian_circuit, coalesce(has_eulerian_path, false) AS has_eulerian_path, coalesce(largest_covers_all, false) AS largest_covers_all, coalesce(single_stroke, false) AS single_stroke FROM (SELECT DISTINCT pattern_id FROM trace) t LEFT JOIN ({sql._VALIDITY}) USING (pattern_id)",
        "node", "edge", "degree", recursive=sql._VALID,
    ),
    "parameter_grid": "SELECT threshold::DOUBLE AS threshold, min_distance::DOUBLE AS min_distance FROM (VALUES (0.2), (0.3), (0.4), (0.5), (0.6)) a(threshold), (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) b(min_distance)",
    "baseline_lookup": "SELECT *, recall > base_recall AS beats_recall, ratio > base_ratio AS beats_ratio FROM (SELECT pattern_id, 0.9::DOUBLE AS recall, round_even(ratio, 4) AS ratio, CASE WHEN pattern_id % 2 = 0 THEN 0.95::DOUBLE END AS base_recall, CASE WHEN pattern_id % 2 = 0 THEN 0.5::DOUBLE END AS base_ratio FROM (" + sql.ORACLE["description_length"] + "))",
    "side_by_side": build(
        "SELECT image_id, n_det AS n_a, NULL::VARCHAR AS error_a, CASE WHEN image_id % 11 = 0 THEN 0 ELSE n_truth END AS n_b, CASE WHEN image_id % 11 = 0 THEN 'timeout' END AS error_b, CASE WHEN image_id % 11 <> 0 THEN hit_det END AS n_agree, CASE WHEN image_id % 11 <> 0 THEN n_det - hit_det END AS a_only, CASE WHEN image_id % 11 <> 0 THEN n_truth - hit_det END AS b_only FROM sides",
        "sides",
    ),
    "shared_members": "WITH m AS (SELECT DISTINCT l_linenumber::BIGINT % 3 AS part, l_partkey FROM lineitem) SELECT x.part AS a, y.part AS b, count(*) AS n_shared FROM m x JOIN m y ON x.l_partkey = y.l_partkey AND x.part < y.part GROUP BY 1, 2",
    "library_ranks": build(f"SELECT pattern_id, {text('canon')} AS motif, min(rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY x, y) AS rank FROM canon WHERE len(canon) > 0) GROUP BY pattern_id, canon", "canon"),
    "match_distances": build("SELECT image_id, round(avg(dist), 9) AS mean, round(median(dist), 9) AS median, round(min(dist), 9) AS least, round(max(dist), 9) AS most FROM (SELECT d.image_id, d.idx, min(sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y))) AS dist FROM det d LEFT JOIN truth t ON d.image_id = t.image_id GROUP BY 1, 2) GROUP BY 1", "det", "truth"),
    "top10_symmetry": build("SELECT pattern_id, error, name AS measure FROM symmetry QUALIFY row_number() OVER (PARTITION BY name ORDER BY error, pattern_id) <= 10", "symmetry"),
    "pixel_frame": build(
        "SELECT pattern_id, x, y, round(x * s + 90 - x0 * s + (720 - sx * s) / 2, 6) AS px, round(y * s + 90 - y0 * s + (720 - sy * s) / 2, 6) AS py FROM (SELECT *, 720.0::DOUBLE / greatest(sx, sy) AS s FROM (SELECT *, greatest(x1 - x0, 1) AS sx, greatest(y1 - y0, 1) AS sy FROM node JOIN box USING (pattern_id)))",
        "box",
    ),
    "dominant_by_symmetry": sql.ORACLE["dominant_motif_symmetric"],
    # queries of the first tier that share these expressions
    "symmetry_error": build("SELECT pattern_id, max(CASE WHEN name = 'vertical' THEN error END) AS vertical, max(CASE WHEN name = 'horizontal' THEN error END) AS horizontal, max(CASE WHEN name = 'rotation180' THEN error END) AS rotation180 FROM symmetry GROUP BY 1", "symmetry"),
    "local_maxima": build("SELECT image_id, row, col, round(v, 6) AS v FROM maxima", "maxima"),
    "gaussian_heatmap": build("SELECT image_id, row, col, round(v, 6) AS v FROM heat", "heat"),
    "nearest_spacing": build("SELECT image_id, count(*) AS n_points, round(median(dist), 9) AS spacing, round(coalesce(CASE WHEN count(*) >= 2 THEN median(dist) * 0.3 END, 5.0), 9) AS radius FROM next GROUP BY 1", "next"),
}
