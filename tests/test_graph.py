import itertools
import random

import pytest

from lineloom.operators import generate, graph, motifs, multiset, pairing


def frames(spark, graphs):
    """node and edge tables from {id: (extra dots, {edge: mult})}."""
    nodes, edges = set(), []
    for k, (dots, strands) in graphs.items():
        nodes |= {(k, *p) for p in dots}
        for (ax, ay, bx, by), m in strands.items():
            nodes |= {(k, ax, ay), (k, bx, by)}
            edges.append((k, ax, ay, bx, by, m))
    return spark.createDataFrame(sorted(nodes), "pattern_id int, x int, y int"), spark.createDataFrame(edges, "pattern_id int, ax int, ay int, bx int, by int, mult bigint")


def cycle(points, m=1):
    out = {}
    for a, b in zip(points, points[1:] + points[:1]):
        e = min(a, b) + max(a, b)
        out[e] = out.get(e, 0) + m
    return out


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
PLUS = {(0, 1, 1, 1): 1, (1, 1, 2, 1): 1, (1, 0, 1, 1): 1, (1, 1, 1, 2): 1}
PATH = {(k, 0, k + 1, 0): 1 for k in range(4)}
TWO = cycle(SQUARE) | cycle([(x + 5, y) for x, y in SQUARE])
TRIANGLES = {**cycle([(0, 0), (1, 0), (0, 1)]), **cycle([(5, 0), (6, 0), (5, 1)]), (1, 0, 5, 0): 2}
BRIDGE = {**TRIANGLES, (1, 0, 5, 0): 1}
GRAPHS = {1: ([], cycle(SQUARE)), 2: ([], TWO), 3: ([], PLUS), 4: ([], PATH), 5: ([], TRIANGLES), 6: ([], BRIDGE), 7: ([], cycle(SQUARE, 2)), 8: ([(9, 9)], {})}


def test_trace_to_edges(spark):
    points = [(1, 0), (2, 1), (2.5, 2), (2, 2.5), (1.5, 2), (2, 1)]
    trace = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(1, 99, None, 1.0)], "pattern_id int, step int, x double, y double")
    visit = graph.visits(trace)
    assert [(r.x, r.y) for r in visit.orderBy("seq").collect()] == [(1, 0), (2, 1)]
    edge = graph.edges(graph.strands(visit)).collect()
    assert [tuple(r) for r in edge] == [(1, 1, 0, 2, 1, 1)]
    empty = trace.where("false")
    assert graph.trace_summary(empty).collect() == []


def test_validity_of_known_graphs(spark):
    got = {r.pattern_id: tuple(r)[1:] for r in graph.validity(*frames(spark, GRAPHS)).collect()}
    assert got[1] == (1, True, True, True, True)
    assert got[2] == (2, True, True, False, False)
    assert got[3] == (1, False, False, True, False)
    assert got[4] == (1, False, True, True, True)
    assert got[5] == (1, True, True, True, True)
    assert got[6] == (1, False, True, True, True)
    assert got[7] == (1, True, True, True, True)
    assert got[8] == (1, True, True, True, True)


def test_euler_trails_use_each_strand_once(spark):
    node, edge = frames(spark, GRAPHS)
    rows = generate.euler_trails(node, edge).collect()
    for k, (_, strands) in GRAPHS.items():
        trail = [(r.x, r.y) for r in sorted((r for r in rows if r.pattern_id == k), key=lambda r: r.seq)]
        if k in (3,):
            assert trail == []
            continue
        walked = {}
        for a, b in zip(trail, trail[1:]):
            e = min(a, b) + max(a, b)
            walked[e] = walked.get(e, 0) + 1
        assert walked == (cycle(SQUARE) if k == 2 else strands)
    assert len([r for r in rows if r.pattern_id == 7]) == 9
    assert [(r.x, r.y) for r in rows if r.pattern_id == 8] == [(9, 9)]


def test_diagnosis(spark):
    got = {r.pattern_id: r for r in generate.diagnoses(*frames(spark, GRAPHS)).collect()}
    assert (got[3].n_odd, got[3].n_corrections, got[3].cost, got[3].is_valid) == (4, 2, 4, False)
    assert (got[6].n_odd, got[6].n_corrections, got[6].cost, got[6].is_valid) == (2, 1, 1, True)
    assert got[6].corrections == ["1,0>5,0"] and got[1].n_corrections == 0
    assert generate.euler_trail(set(), {}) == []


def least_cost(cost):
    def least(free):
        if not free:
            return 0
        return min(cost[free[0]][j] + least([k for k in free[1:] if k != j]) for j in free[1:])

    return least(list(range(len(cost))))


@pytest.mark.parametrize("n", [0, 2, 4, 6, 8, 10])
def test_pairing_is_least(n):
    rng = random.Random(n)
    for most in (3, 50):
        for _ in range(30):
            cost = [[0] * n for _ in range(n)]
            for i, j in itertools.combinations(range(n), 2):
                cost[i][j] = cost[j][i] = rng.randrange(1, most)
            pairs = pairing.least_pairs(cost)
            assert sorted(v for p in pairs for v in p) == list(range(n))
            assert sum(cost[i][j] for i, j in pairs) == least_cost(cost)


def test_pairing_of_many():
    line = [[abs(i - j) for j in range(20)] for i in range(20)]
    assert sum(line[i][j] for i, j in pairing.least_pairs(line)) == 10
    # a 400-vertex lattice pairs with its neighbours
    places = [(x, y) for x in range(20) for y in range(20)]
    cost = [[abs(a - c) + abs(b - d) for c, d in places] for a, b in places]
    assert sum(cost[i][j] for i, j in pairing.least_pairs(cost)) == 200


def test_degrees_count_loops_and_isolated(spark):
    node, edge = frames(spark, {1: ([(7, 7)], {(0, 0, 0, 0): 1, (0, 0, 1, 0): 3})})
    assert {(r.x, r.y): r.degree for r in graph.degrees(node, edge).collect()} == {(0, 0): 5, (1, 0): 3, (7, 7): 0}


def test_reconciliation_audit(spark):
    cases = {1: (5, 2), 2: (6, 4), 3: (2, 5), 4: (1, 2), 5: (0, 3), 6: (3, 0)}
    src = frames(spark, {k: ([], {(0, 0, 1, 0): a}) for k, (a, _) in cases.items() if a})[1]
    made = frames(spark, {k: ([], {(0, 0, 1, 0): b}) for k, (_, b) in cases.items() if b})[1]
    rec = generate.reconstruct(src, made)
    got = {r.pattern_id: (r.kept, r.excess, r.deficit) for r in rec.collect()}
    assert got == {1: (2, 0, 3), 2: (4, 0, 2), 3: (2, 3, 0), 4: (1, 1, 0), 5: (0, 3, 0), 6: (0, 0, 3)}
    assert all(r.self_consistent for r in generate.compare_to_source(rec).collect())
    with pytest.raises(ValueError):
        generate.reconstruct(src, made, policy="other")
    assert {r.pattern_id: r.mult for r in multiset.plus(src, made).collect()}[1] == 7
    assert {r.pattern_id: r.consistent for r in multiset.self_consistency(src, made).collect()} == dict.fromkeys(cases, False)


def test_windows_and_interior(spark):
    dots = [(x, y) for x in range(5) for y in range(5)]
    node, edge = frames(spark, {1: (dots, {(1, 1, 1, 2): 1, (1, 1, 2, 1): 2, (0, 0, 4, 4): 1})})
    assert {(r.x, r.y) for r in motifs.interior(node, 1).collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)}
    got = {(r.x, r.y): r.motif for r in motifs.windows(node, edge, 1).collect()}
    assert len(got) == 9 and got[1, 1] == [[0, 0, 0, 1], [0, 0, 1, 0], [0, 0, 1, 0]] and got[3, 3] == []
    top = motifs.dominant(motifs.windows(node, edge, 1)).first()
    assert (top.motif, top.n, top.n_interior) == ([], 5, 9)
