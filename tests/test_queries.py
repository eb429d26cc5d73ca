import math

from lineloom.operators import matching, selection
from lineloom.plans import queries


def captured(monkeypatch, name):
    """(radii, selector) that a query hands to the grouped operator."""
    out = []
    monkeypatch.setattr(queries, "_node", lambda s, d: None)
    monkeypatch.setattr(queries, "_edge", lambda s, d: None)
    monkeypatch.setattr(selection, "task_frame", lambda node, edge, radii: tuple(radii))
    monkeypatch.setattr(selection, "grouped", lambda frame, select: out.append((frame, select)))
    queries.QUERIES[name](None, "")
    return out[0]


def test_growing_selectors_get_windows_of_all_radii(monkeypatch):
    dots = {(x, y) for x in range(40) for y in range(9)}
    # crosses of double strands that span 6 cells, which only windows of radius 3 hold
    cross = "-3,0>3,0;-3,0>3,0;0,-3>0,3;0,-3>0,3"
    strands, places = selection.Counter(), [(x, 4) for x in range(4, 36, 8)]
    for x, y in places:
        strands[x - 3, y, x + 3, y] += 2
        strands[x, y - 3, x, y + 3] += 2
    task = selection.Task(dots, strands, {3: [(p, cross, sorted(selection.D4)[0]) for p in places]})
    for name in ("mdl_select", "multiplicity_select", "eulerian_select"):
        radii, select = captured(monkeypatch, name)
        assert radii == (1, 2, 3)
        chosen, left, *_ = select(task)
        assert [c.radius for c in chosen] == [3] and not left


def test_novel_place_tries_the_whole_library(monkeypatch):
    tried = []
    monkeypatch.setattr(selection, "novel_place", lambda library, dots, inside: tried.append(list(library)) or [])
    dots = {(x, y) for x in range(40) for y in range(3)}
    # six closed motifs that differ, each at its own place: as many strands both ways as keep every vertex even
    seen, strands = [], selection.Counter()
    for k in range(6):
        x = 3 + 6 * k
        motif = ["-1,0>0,0"] * 2 * (k + 1)
        seen.append(((x, 1), ";".join(motif), sorted(selection.D4)[0]))
    monkeypatch.setattr(selection, "oriented", lambda text, transform: selection.parse(text))
    for (x, _), text, _ in seen:
        for ax, ay, bx, by in selection.parse(text):
            strands[x + ax, 1 + ay, x + bx, 1 + by] += 1
    # every motif comes twice, so that its placements pay for its rule
    seen += [((x, 2), text, t) for (x, _), text, t in seen]
    for (x, y), text, _ in seen[6:]:
        for ax, ay, bx, by in selection.parse(text):
            strands[x + ax, y + ay, x + bx, y + by] += 1
    task = selection.Task(dots, strands, {1: seen})
    wanted = [c.canon for c in selection.budgeted_select(task, radius=1, max_radius=1, parity=True)[0]]
    out = []
    monkeypatch.setattr(queries, "_selected", lambda select: lambda s, d: out.append(select) or queries._parts)
    try:
        queries.novel_place(None, "")
    except AttributeError:  # the selector is all that is asked for
        pass
    out[0](task)
    assert len(wanted) == 6 and tried == [wanted]


def test_spacing_counts_neighbours_at_any_distance(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 400.0, 0.0), (2, 1, 0.0, 0.0), (2, 2, 300.0, 400.0), (3, 1, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "image_id int, idx bigint, x double, y double")
    assert {(r.image_id, r.idx): r.dist for r in matching.neighbour_distances(points, 100.0).collect()} == {(1, 1): 10.0, (1, 2): 10.0, (1, 3): 390.0, (2, 1): 500.0, (2, 2): 500.0, (3, 1): None}
    assert {r.image_id: r.spacing for r in matching.dot_radius(points, 100.0).collect()} == {1: 10.0, 2: 500.0, 3: None}


def test_heat_reaches_all_that_rounding_keeps(spark, monkeypatch):
    points = spark.createDataFrame([(1, 1, 450.0, 457.0)], "image_id int, idx bigint, x double, y double")
    monkeypatch.setattr(queries, "_points", lambda s, d, side: points)
    got = {(r.row, r.col): r.v for r in queries.gaussian_heatmap(spark, "").collect()}
    v = {(r, c): round(math.exp(-((32.0 - c) ** 2 + (457 / 900 * 64 - r) ** 2) / 0.72), 6) for r in range(64) for c in range(64)}
    assert all(abs(got.get(at, 0.0) - x) < 2e-6 for at, x in v.items())
