import math
import random

import numpy as np
import pytest

from lineloom.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, rep string, n string, lead string, component string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "r", "n", "l", "c") for i, v, lab in rows], SCHEMA)


def brute(rows, limit=0.93):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= limit:
                links[a] += 1
                links[b] += 1
                root[top(b)] = top(a)
    least = {}
    for k in range(len(rows)):
        least[top(k)] = min(least.get(top(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], least[top(k)], rows[k][0] == least[top(k)]) for k in range(len(rows)))


def clusters(seed, n, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        c = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), (c + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.15, 0.25])).tolist(), int(g % 3)))
    return rows


def test_recall_and_exact_counts(spark):
    rows = clusters(1, 120)
    got = embeddings.near_duplicates(make(spark, rows), run_size=64).collect()
    want = brute(rows)
    found, there = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.97 * there
    by = {w[0]: w for w in want}
    assert sum(r.component_id == by[r.vec_id][2] for r in got) >= 0.97 * len(got)
    assert all(r.n_links <= by[r.vec_id][1] for r in got)  # none below the limit


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(4, v, 1), (3, [2.0, 4.0, 6.0, 8.0], 1), (9, v, 2), (8, v, None), (7, None, 1), (6, [], 1), (5, [0.0] * 4, 1), (10, [1.0, None, 3.0, 4.0], 1), (11, [1.0, float("nan"), 3.0, 4.0], 1), (12, [float("inf"), 2.0, 3.0, 4.0], 1), (13, [1.0, 2.0, 3.0], 1), (4, v, 1), (14, [-1.0, -2.0, -3.0, -4.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(make(spark, rows)).collect())
    assert got == brute(rows)


def test_null_ids_and_empty(spark):
    v = [1.0, 0.5, -0.25]
    got = embeddings.near_duplicates(make(spark, [(None, v, 1), (2, v, 1)])).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("2", 1, 2, True), ("None", 1, 2, False)]
    assert embeddings.near_duplicates(make(spark, [])).collect() == []


def test_large_group_of_copies(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 1e-3) for x in base], 1) for i in range(600)]
    got = embeddings.near_duplicates(make(spark, rows), run_size=100).collect()
    assert {r.n_links for r in got} == {599} and {r.component_id for r in got} == {0}


def test_calibration_is_monotone_and_counts_are_windows():
    half, least = embeddings.calibrate(0.93, 64, 32, 1.2, 0.995)
    assert embeddings.calibrate(0.93, 64, 32, 1.2, 0.9)[1] >= least
    rng = np.random.default_rng(0)
    q, o = rng.standard_normal((20, 7)).astype(np.float32), rng.standard_normal((50, 7)).astype(np.float32)
    got = embeddings.collisions(q, o, 0.3)
    assert (got == (np.abs(q[:, None] - o[None]) <= np.float32(0.3)).sum(2)).mean() > 0.999


@pytest.mark.parametrize("per_key", [3, 6])
def test_bands_find_pairs_at_the_limit_once(spark, per_key):
    """Pairs planted at cosines from 0.93: keys over several tables find nearly all, and count each once."""
    rng = np.random.default_rng(per_key)
    rows, planted = [], {}
    for k in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cosine = [0.9301, 0.935, 0.94, 0.95][k % 4]
        planted[2 * k] = cosine
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist(), 1)]
    want = brute(rows)
    got = {r.vec_id: r for r in embeddings.near_duplicates(make(spark, rows), per_key=per_key, run_size=100).collect()}
    by = {w[0]: w for w in want}
    assert all(r.n_links <= by[i][1] for i, r in got.items())
    for cosine in set(planted.values()):
        there = [i for i, c in planted.items() if c == cosine and by[i][1]]
        assert there and sum(got[i].n_links == by[i][1] for i in there) >= 0.97 * len(there), cosine


def test_bands_follow_the_size():
    sizes = [embeddings.bands(10**k, 0.93, 0.999) for k in range(2, 10)]
    assert sizes[0] == (0, 1) and [k for k, _ in sizes] == sorted(k for k, _ in sizes) and sizes[-1][0] > 8
    # the chance that cells of six spreads keep a pair, by simulation
    rng = np.random.default_rng(0)
    x, d = rng.random(200_000) * 6, rng.standard_normal(200_000)
    assert abs((np.floor(x / 6) == np.floor((x + d) / 6)).mean() - embeddings._KEPT) < 0.005


def test_negative_zeros_are_zeros(spark):
    rows = [(1, [0.0, 1.0, 2.0], 1), (2, [-0.0, 1.0, 2.0], 1), (3, [9.0, 1.0, 2.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(make(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
