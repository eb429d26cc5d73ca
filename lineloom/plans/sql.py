"""DuckDB SQL of the driver's queries, from common table expressions that build on each other."""

from __future__ import annotations

import re

_CTE = {
    "trace": "SELECT user_id AS pattern_id, event_id AS step, (CAST(floor(value * 100) AS BIGINT) % 17) / 2.0::DOUBLE AS x, (event_id % 13) / 2.0::DOUBLE AS y FROM events",
    "dot": "SELECT pattern_id, step, x::INT AS x, y::INT AS y FROM trace WHERE x = floor(x) AND y = floor(y)",
    "lagged": "SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM dot WINDOW w AS (PARTITION BY pattern_id ORDER BY step)",
    "visit": "SELECT pattern_id, row_number() OVER (PARTITION BY pattern_id ORDER BY step) AS seq, x, y FROM lagged WHERE px IS NULL OR px <> x OR py <> y",
    "pair": "SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM visit WINDOW w AS (PARTITION BY pattern_id ORDER BY seq)",
    "strand": "SELECT pattern_id, seq, CASE WHEN s THEN nx ELSE x END AS ax, CASE WHEN s THEN ny ELSE y END AS ay, CASE WHEN s THEN x ELSE nx END AS bx, CASE WHEN s THEN y ELSE ny END AS by FROM (SELECT *, nx < x OR (nx = x AND ny < y) AS s FROM pair WHERE nx IS NOT NULL)",
    "edge": "SELECT pattern_id, ax, ay, bx, by, count(*) AS mult FROM strand GROUP BY ALL",
    "node": "SELECT DISTINCT pattern_id, x, y FROM visit",
    "fin": "SELECT pattern_id, ax AS x, ay AS y, mult FROM edge UNION ALL SELECT pattern_id, bx, by, mult FROM edge",
    "degree": "SELECT pattern_id, x, y, coalesce(sum(mult), 0)::BIGINT AS degree FROM node LEFT JOIN fin USING (pattern_id, x, y) GROUP BY ALL",
    "box": "SELECT pattern_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM node GROUP BY ALL",
    "inner1": "SELECT pattern_id, x, y FROM node JOIN box USING (pattern_id) WHERE x BETWEEN x0 + 1 AND x1 - 1 AND y BETWEEN y0 + 1 AND y1 - 1",
    "rel": "SELECT c.pattern_id, c.x, c.y, [ax - c.x, ay - c.y, bx - c.x, by - c.y] AS e, mult FROM inner1 c JOIN edge d ON c.pattern_id = d.pattern_id AND abs(ax - c.x) <= 1 AND abs(ay - c.y) <= 1 AND abs(bx - c.x) <= 1 AND abs(by - c.y) <= 1",
    "many": "SELECT pattern_id, x, y, e FROM (SELECT *, unnest(range(mult)) AS i FROM rel)",
    "win": "SELECT c.pattern_id, c.x, c.y, coalesce(list_sort(m), []) AS motif FROM inner1 c LEFT JOIN (SELECT pattern_id, x, y, list(e) AS m FROM many GROUP BY ALL) USING (pattern_id, x, y)",
    "d4": "SELECT * FROM (VALUES (1,'identity',1,0,0,1),(2,'rot90',0,-1,1,0),(3,'rot180',-1,0,0,-1),(4,'rot270',0,1,-1,0),(5,'reflect_x',1,0,0,-1),(6,'reflect_y',-1,0,0,1),(7,'reflect_diag',0,1,1,0),(8,'reflect_antidiag',0,-1,-1,0)) t(i, name, p, q, r, s)",
    "img0": "SELECT motif, i, name, [p*e[1]+q*e[2], r*e[1]+s*e[2], p*e[3]+q*e[4], r*e[3]+s*e[4]] AS e FROM (SELECT motif, unnest(motif) AS e FROM (SELECT DISTINCT motif FROM win)), d4",
    "img": "SELECT motif, i, name, list_sort(list(CASE WHEN e[3] < e[1] OR (e[3] = e[1] AND e[4] < e[2]) THEN [e[3], e[4], e[1], e[2]] ELSE e END)) AS image FROM img0 GROUP BY ALL",
    "canon0": "SELECT motif, min(image) AS canon FROM img GROUP BY motif",
    "canon": "SELECT w.*, coalesce(c.canon, []) AS canon FROM win w LEFT JOIN canon0 c USING (motif)",
    "cimg0": "SELECT canon, i, name, [p*e[1]+q*e[2], r*e[1]+s*e[2], p*e[3]+q*e[4], r*e[3]+s*e[4]] AS e FROM (SELECT canon, unnest(canon) AS e FROM (SELECT DISTINCT canon FROM canon0)), d4",
    "cimg": "SELECT canon, i, name, list_sort(list(CASE WHEN e[3] < e[1] OR (e[3] = e[1] AND e[4] < e[2]) THEN [e[3], e[4], e[1], e[2]] ELSE e END)) AS image FROM cimg0 GROUP BY ALL",
    "turn0": "SELECT c.motif, min_by(b.name, b.i) AS transform FROM canon0 c JOIN cimg b ON b.canon = c.canon AND b.image = c.motif GROUP BY c.motif",
    "det": "SELECT DISTINCT l_orderkey // 40 AS image_id, (l_partkey * 7 % 900) * 10000 + l_suppkey * 13 % 900 AS idx, (l_partkey * 7 % 900)::DOUBLE AS x, (l_suppkey * 13 % 900)::DOUBLE AS y FROM lineitem",
    "truth": "SELECT DISTINCT l_orderkey // 40 AS image_id, (l_partkey * 7 % 900 + l_orderkey % 41) * 10000 + l_suppkey * 13 % 900 + l_linenumber::BIGINT * 7 % 23 AS idx, (l_partkey * 7 % 900 + l_orderkey % 41)::DOUBLE AS x, (l_suppkey * 13 % 900 + l_linenumber * 7 % 23)::DOUBLE AS y FROM lineitem",
    "near": "SELECT d.image_id, d.idx, t.idx AS other, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS dist FROM det d JOIN truth t ON d.image_id = t.image_id AND abs(d.x - t.x) < 30 AND abs(d.y - t.y) < 30 WHERE sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) < 30",
    "hits": "SELECT image_id, count(DISTINCT idx) AS hit_det, count(DISTINCT other) AS hit_truth FROM near GROUP BY 1",
    "sides": "SELECT image_id, coalesce(n_det, 0) AS n_det, coalesce(n_truth, 0) AS n_truth, coalesce(hit_det, 0) AS hit_det, coalesce(hit_truth, 0) AS hit_truth FROM (SELECT image_id, count(*) AS n_det FROM det GROUP BY 1) FULL JOIN (SELECT image_id, count(*) AS n_truth FROM truth GROUP BY 1) USING (image_id) LEFT JOIN hits USING (image_id)",
    "pr": "SELECT *, CASE WHEN n_det = 0 THEN 1.0 WHEN n_truth = 0 THEN 0.0 ELSE hit_det / n_det END::DOUBLE AS precision, CASE WHEN n_truth = 0 THEN 1.0 ELSE hit_truth / n_truth END::DOUBLE AS recall FROM sides",
    "made0": "SELECT pattern_id, e[1] + x AS ax, e[2] + y AS ay, e[3] + x AS bx, e[4] + y AS by FROM (SELECT pattern_id, x, y, unnest(motif) AS e FROM win)",
    "made": "SELECT m.pattern_id, ax, ay, bx, by, count(*) AS mult FROM made0 m JOIN node a ON a.pattern_id = m.pattern_id AND a.x = ax AND a.y = ay JOIN node b ON b.pattern_id = m.pattern_id AND b.x = bx AND b.y = by GROUP BY ALL",
    "sup": "SELECT l_suppkey AS pattern_id, l_partkey AS p, count(*) AS mult FROM lineitem GROUP BY ALL",
}
_NEEDS = {
    "dot": ["trace"], "lagged": ["dot"], "visit": ["lagged"], "pair": ["visit"], "strand": ["pair"], "edge": ["strand"], "node": ["visit"], "fin": ["edge"], "degree": ["node", "fin"], "box": ["node"], "inner1": ["box"], "rel": ["inner1", "edge"],
    "many": ["rel"], "win": ["many"], "img0": ["win", "d4"], "img": ["img0"], "canon0": ["img"], "canon": ["canon0"], "cimg0": ["canon0", "d4"], "cimg": ["cimg0"], "turn0": ["cimg"], "near": ["det", "truth"], "hits": ["near"], "sides": ["hits"], "pr": ["sides"], "made0": ["win"], "made": ["made0", "node"],
}


def build(select: str, *used: str, recursive: str = "") -> str:
    """The statement with the expressions it uses and those below them."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for name in used:
        add(name)
    parts = [f"{name} AS ({_CTE[name]})" for name in order] + ([recursive] if recursive else [])
    whole = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {select}"
    whole = re.sub(r"\bby\b", '"by"', whole)  # the column; the keyword is in capitals
    while (at := whole.find("count_if(")) >= 0:  # count_if gives a 128-bit number
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(whole[end], 0)
            end += 1
        whole = f"{whole[:at]}count(*) FILTER (WHERE {whole[at + 9 : end - 1]}){whole[end:]}"
    return whole


def text(motif: str) -> str:
    """A motif as text, as the Spark side writes it."""
    return f"array_to_string(list_transform({motif}, lambda e: e[1]::VARCHAR || ',' || e[2]::VARCHAR || '>' || e[3]::VARCHAR || ',' || e[4]::VARCHAR), ';')"


_REACH = "reach AS (SELECT pattern_id, x, y, x AS rx, y AS ry FROM node UNION SELECT r.pattern_id, l.x2, l.y2, r.rx, r.ry FROM reach r JOIN link l ON l.pattern_id = r.pattern_id AND l.x1 = r.x AND l.y1 = r.y)"
_LINK = "link AS (SELECT pattern_id, ax AS x1, ay AS y1, bx AS x2, by AS y2 FROM edge UNION SELECT pattern_id, bx, by, ax, ay FROM edge)"
_ROOT = "root AS (SELECT pattern_id, x, y, min((rx, ry)) AS r FROM reach GROUP BY ALL)"
_PART = "part AS (SELECT pattern_id, r, count(*) AS n, count_if(degree % 2 = 1) AS odd FROM root JOIN degree USING (pattern_id, x, y) GROUP BY ALL)"
_BEST = "best AS (SELECT pattern_id, count(*) AS components, sum(n) AS n_nodes, first(n ORDER BY n DESC, r) AS n1, first(odd ORDER BY n DESC, r) AS odd1 FROM part GROUP BY ALL)"
_VALID = ", ".join((_LINK, _REACH, _ROOT, _PART, _BEST))
_VALIDITY = "SELECT pattern_id, components, odd1 = 0 AS is_eulerian_circuit, odd1 IN (0, 2) AS has_eulerian_path, n1 = n_nodes AS largest_covers_all, n1 = n_nodes AND odd1 IN (0, 2) AS single_stroke FROM best"

_RECON = "SELECT pattern_id, ax, ay, bx, by, coalesce(e.mult, 0) AS target, coalesce(o.mult, 0) AS produced FROM edge e FULL JOIN made o USING (pattern_id, ax, ay, bx, by)"

ORACLE: dict[str, str] = {
    "trace_summary": build(
        "SELECT t.pattern_id, t.n_points, t.min_x, t.max_x, t.min_y, t.max_y, t.closed, coalesce(d.n_dots, 0) AS n_dots, coalesce(d.n_odd, 0) AS n_odd, coalesce(e.n_strands, 0)::BIGINT AS n_strands, coalesce(e.n_edges, 0) AS n_edges, coalesce(e.n_repeated, 0) AS n_repeated FROM "
        "(SELECT pattern_id, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, arg_min(x, step) = arg_max(x, step) AND arg_min(y, step) = arg_max(y, step) AS closed FROM trace GROUP BY 1) t "
        "LEFT JOIN (SELECT pattern_id, count(*) AS n_dots, count_if(degree % 2 = 1) AS n_odd FROM degree GROUP BY 1) d USING (pattern_id) LEFT JOIN (SELECT pattern_id, sum(mult) AS n_strands, count(*) AS n_edges, count_if(mult > 1) AS n_repeated FROM edge GROUP BY 1) e USING (pattern_id)",
        "degree",
    ),
    "dot_visits": build("SELECT * FROM visit", "visit"),
    "edge_multiplicity": build("SELECT * FROM edge", "edge"),
    "repeated_pairs": build("SELECT pattern_id, count_if(mult > 1) AS n_repeated, max(mult) AS most FROM edge GROUP BY 1", "edge"),
    "degree_parity": build("SELECT pattern_id, x, y, degree, degree % 2 = 1 AS odd FROM degree", "degree"),
    "path_length": build(
        "SELECT pattern_id, round(coalesce(sum(d), 0.0), 6) AS path_length, sqrt((arg_min(x, step) - arg_max(x, step)) ** 2 + (arg_min(y, step) - arg_max(y, step)) ** 2) AS closure_gap, max(x) - min(x) AS width, max(y) - min(y) AS height FROM "
        "(SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d FROM trace WINDOW w AS (PARTITION BY pattern_id ORDER BY step)) GROUP BY 1",
        "trace",
    ),
    "parallel_ordinal": build("SELECT pattern_id, seq, ax, ay, bx, by, row_number() OVER (PARTITION BY pattern_id, ax, ay, bx, by ORDER BY seq) - 1 AS ordinal FROM strand", "strand"),
    "interior_points": build("SELECT * FROM inner1", "inner1"),
    "local_windows": build(f"SELECT pattern_id, x, y, len(motif)::BIGINT AS n_edges, {text('motif')} AS motif FROM win", "win"),
    "canonical_motifs": build(f"SELECT pattern_id, x, y, {text('canon')} AS canon, coalesce(t.transform, 'identity') AS transform FROM canon LEFT JOIN turn0 t USING (motif)", "canon", "turn0"),
    "dominant_motif": build(
        f"SELECT pattern_id, {text('motif')} AS motif, n, n_interior, n / n_interior AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, motif) AS r, sum(n) OVER (PARTITION BY pattern_id)::BIGINT AS n_interior FROM (SELECT pattern_id, motif, count(*) AS n FROM win GROUP BY ALL)) WHERE r = 1",
        "win",
    ),
    "dominant_motif_symmetric": build(
        f"SELECT pattern_id, {text('canon')} AS canon, n, n_interior, n / n_interior AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, canon) AS r, sum(n) OVER (PARTITION BY pattern_id)::BIGINT AS n_interior FROM (SELECT pattern_id, canon, count(*) AS n FROM canon GROUP BY ALL)) WHERE r = 1",
        "canon",
    ),
    "candidate_groups": build(f"SELECT pattern_id, {text('canon')} AS canon, count(*) AS n_points, min((x, y))[1]::INT AS first_x FROM canon WHERE len(canon) > 0 GROUP BY pattern_id, canon".replace("min((x, y))[1]::INT", "min(x)"), "canon"),
    "stamped_edges": build(
        f"SELECT k.pattern_id, k.canon, k.ax, k.ay, k.bx, k.by, count(*) AS n FROM (SELECT pattern_id, {text('canon')} AS canon, e[1] + x AS ax, e[2] + y AS ay, e[3] + x AS bx, e[4] + y AS by FROM (SELECT pattern_id, canon, x, y, unnest(motif) AS e FROM canon)) k "
        "JOIN node a ON a.pattern_id = k.pattern_id AND a.x = k.ax AND a.y = k.ay JOIN node b ON b.pattern_id = k.pattern_id AND b.x = k.bx AND b.y = k.by GROUP BY ALL",
        "canon",
    ),
    "reconcile_pairs": build(f"SELECT *, least(target, produced) AS kept, greatest(produced - target, 0) AS excess, greatest(target - produced, 0) AS deficit FROM ({_RECON})", "edge", "made"),
    "compare_to_source": build(
        "SELECT pattern_id, sum(target)::BIGINT AS source_strands, count_if(target > 0) AS source_pairs, sum(produced)::BIGINT AS produced_strands, count_if(produced > 0) AS produced_pairs, sum(least(target, produced))::BIGINT AS kept_strands, count_if(least(target, produced) > 0) AS kept_pairs, "
        "sum(greatest(target - produced, 0))::BIGINT AS residual_strands, count_if(target > produced) AS residual_pairs, sum(greatest(produced - target, 0))::BIGINT AS excess_strands, count_if(produced > target) AS excess_pairs, true AS self_consistent, "
        f"CASE WHEN count_if(target > 0) > 0 THEN count_if(least(target, produced) > 0) / count_if(target > 0) ELSE 1.0 END::DOUBLE AS pair_recall, CASE WHEN sum(target) > 0 THEN sum(least(target, produced))::DOUBLE / sum(target)::DOUBLE ELSE 1.0 END::DOUBLE AS strand_recall FROM ({_RECON}) GROUP BY 1",
        "edge", "made",
    ),
    "multiset_intersect": build("SELECT pattern_id, ax, ay, bx, by, least(e.mult, o.mult) AS mult FROM edge e JOIN made o USING (pattern_id, ax, ay, bx, by)", "edge", "made"),
    "multiset_minus": build("SELECT pattern_id, ax, ay, bx, by, e.mult - coalesce(o.mult, 0) AS mult FROM edge e LEFT JOIN made o USING (pattern_id, ax, ay, bx, by) WHERE e.mult > coalesce(o.mult, 0)", "edge", "made"),
    "multiset_plus": build("SELECT pattern_id, ax, ay, bx, by, sum(mult)::BIGINT AS mult FROM (SELECT * FROM edge UNION ALL SELECT * FROM made) GROUP BY ALL", "edge", "made"),
    "union_pairs": build("SELECT pattern_id, ax, ay, bx, by FROM edge UNION SELECT pattern_id, ax, ay, bx, by FROM made", "edge", "made"),
    "self_consistency": build("SELECT pattern_id, bool_and(e.mult IS NOT DISTINCT FROM o.mult) AS consistent FROM edge e FULL JOIN made o USING (pattern_id, ax, ay, bx, by) GROUP BY 1", "edge", "made"),
    "duplicates_source": build(
        "SELECT n.pattern_id, CASE WHEN NOT n.same THEN 'other layout' WHEN coalesce(c.consistent, true) THEN 'yes' ELSE 'no' END AS duplicates FROM (SELECT pattern_id, bool_and(a AND b) AS same FROM (SELECT pattern_id, coalesce(p.o, false) AS a, coalesce(q.o, false) AS b FROM (SELECT *, true AS o FROM ends0) p FULL JOIN (SELECT *, true AS o FROM node) q USING (pattern_id, x, y)) GROUP BY 1) n "
        "LEFT JOIN (SELECT pattern_id, bool_and(e.mult IS NOT DISTINCT FROM o.mult) AS consistent FROM edge e FULL JOIN made o USING (pattern_id, ax, ay, bx, by) GROUP BY 1) c USING (pattern_id)".replace("ends0", "(SELECT pattern_id, ax AS x, ay AS y FROM made UNION SELECT pattern_id, bx, by FROM made)"),
        "edge", "made", "node",
    ),
    "edge_recall": build("SELECT pattern_id, count(*) AS n_pairs, count(o.mult) AS n_found, count(o.mult) / count(*) AS recall FROM edge LEFT JOIN made o USING (pattern_id, ax, ay, bx, by) GROUP BY 1", "edge", "made"),
    "motif_library": build(f"SELECT {text('canon')} AS motif, min(pattern_id) AS first_pattern, count(DISTINCT pattern_id) AS n_patterns FROM canon WHERE len(canon) > 0 GROUP BY canon", "canon"),
    "connected_components": build("SELECT pattern_id, x, y, r[1]::INT AS root_x, r[2]::INT AS root_y FROM root".replace("r[1]::INT", "struct_extract_at(r, 1)").replace("r[2]::INT", "struct_extract_at(r, 2)"), "node", "edge", recursive=", ".join((_LINK, _REACH, _ROOT))),
    "validity_report": build(_VALIDITY, "node", "edge", "degree", recursive=_VALID),
    "single_stroke_gate": build(f"SELECT single_stroke, count(*) AS n_patterns, sum(components)::BIGINT AS n_components FROM ({_VALIDITY}) GROUP BY 1", "node", "edge", "degree", recursive=_VALID),
    "tolerance_match": build("SELECT image_id, idx, arg_min(other, (dist, other)) AS other, round(min(dist), 9) AS dist FROM near GROUP BY 1, 2", "near"),
    "precision_recall": build("SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM pr", "pr"),
    "detector_summary": build("SELECT count(*) AS n_images, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END), 9) AS mean_f1, round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 9) AS f1_of_means FROM pr", "pr"),
    "agreement": build("SELECT image_id, n_det AS n_a, n_truth AS n_b, hit_det AS n_agree, n_det - hit_det AS a_only, n_truth - hit_det AS b_only FROM sides", "sides"),
    "fp_rate": build("SELECT count(*) AS n_images, count_if(n_det > 0) AS n_false, avg((n_det > 0)::INT::DOUBLE) AS rate FROM sides", "sides"),
    "summary_stats": build("SELECT count(n) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM (SELECT pattern_id, sum(mult)::BIGINT AS n FROM edge GROUP BY 1)", "edge"),
    "top10_path_length": build("SELECT pattern_id, count(*) AS n_points FROM trace GROUP BY 1 ORDER BY n_points DESC, pattern_id LIMIT 10", "trace"),
    "cumulative_recall": build(
        "SELECT *, min(CASE WHEN recall >= 0.95 THEN rank END) OVER (PARTITION BY pattern_id) AS first_rank FROM (SELECT pattern_id, rank, n, n_total, covered, covered / n_total AS recall FROM (SELECT *, sum(n) OVER (PARTITION BY pattern_id ORDER BY rank)::BIGINT AS covered, sum(n) OVER (PARTITION BY pattern_id)::BIGINT AS n_total FROM "
        "(SELECT pattern_id, row_number() OVER (PARTITION BY pattern_id ORDER BY mult DESC, ax, ay, bx, by) AS rank, mult AS n FROM edge)))",
        "edge",
    ),
    "archive_search": "SELECT p_partkey AS id, p_name FROM part WHERE contains(p_partkey::VARCHAR, '12') OR contains('pattern ' || p_partkey::VARCHAR, '12') OR contains('pattern-' || (p_partkey - 1)::VARCHAR, '12')",
    "pagination": "SELECT p_partkey AS id, p_name FROM part ORDER BY id LIMIT 36 OFFSET 72",
    "archive_neighbours": "SELECT p_partkey AS id, coalesce(lag(p_partkey) OVER (ORDER BY p_partkey), -1) AS previous, coalesce(lead(p_partkey) OVER (ORDER BY p_partkey), -1) AS following FROM part",
    "trace_ends": build("SELECT pattern_id, step, x, y FROM trace QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY step) <= 5 OR row_number() OVER (PARTITION BY pattern_id ORDER BY step DESC) <= 5", "trace"),
    "failure_reasons": build("SELECT reason, count(*) AS n_images FROM (SELECT CASE WHEN n_det = 0 THEN 'nothing_found' WHEN n_truth = 0 THEN 'no_truth' WHEN f1 < 0.5 THEN 'poor_match' WHEN n_det > 2 * n_truth THEN 'too_many' ELSE 'ok' END AS reason FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)) GROUP BY 1", "pr"),
    "dotted_classifier": build("SELECT pattern_id, n_nodes, n_odd, n_odd / n_nodes <= 0.5 AS dotted FROM (SELECT pattern_id, count(*) AS n_nodes, count_if(degree % 2 = 1) AS n_odd FROM degree GROUP BY 1)", "degree"),
    "description_length": build(
        f"SELECT pattern_id, n_strands, size, CASE WHEN size > 0 THEN 4 * n_strands / size ELSE 0.0 END::DOUBLE AS ratio FROM (SELECT e.pattern_id, e.n_strands, (coalesce(m.cost, 0) + 4 * e.n_strands)::BIGINT AS size FROM (SELECT pattern_id, sum(mult)::BIGINT AS n_strands FROM edge GROUP BY 1) e LEFT JOIN (SELECT pattern_id, sum(4 * len(canon) + 3 * n) AS cost FROM (SELECT pattern_id, canon, count(*) AS n FROM canon WHERE len(canon) > 0 GROUP BY ALL) GROUP BY 1) m USING (pattern_id))",
        "edge", "canon",
    ),
    "reconstruct": build("SELECT pattern_id, ax, ay, bx, by, mult FROM edge", "edge"),
}
