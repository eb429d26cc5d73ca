import contextlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.operators import heatmap, matching, populations
from lineloom.plans.queries import QUERIES as CORE
from lineloom.plans.report_queries import QUERIES as REPORTS

POINTS = "image_id bigint, idx bigint, x double, y double"
SIGMA, SIZE, SOURCE, REACH = 0.6, 16, 90.0, 3


def _dots(n=400, images=5, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(int(k % images), k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 110, (n, 2)))]
    return [*rows, *rows[:9], (None, n, 4.0, 5.0), (7, n + 1, None, 3.0), (8, n + 2, float("nan"), 3.0), (9, n + 3, 500.0, 3.0)]


def _heats(dots):
    """image: {(row, col): v}, by plain loops."""
    out: dict = {}
    for image, _, x, y in dots:
        if x is None or x != x:
            continue
        cx, cy = x / SOURCE * SIZE, y / SOURCE * SIZE
        for c in range(max(0, math.floor(cx) - REACH), min(SIZE - 1, math.floor(cx) + REACH) + 1):
            for r in range(max(0, math.floor(cy) - REACH), min(SIZE - 1, math.floor(cy) + REACH) + 1):
                v = math.exp(-((cx - c) ** 2 + (cy - r) ** 2) / (2 * SIGMA * SIGMA))
                out.setdefault(image, {})[r, c] = max(v, out.get(image, {}).get((r, c), 0.0))
    return out


@pytest.fixture(params=["points", "table", "small batches"])
def heat(request, spark, monkeypatch):
    """The same heatmaps as points and as a table of cells, also in batches that part images."""
    dots = _dots()
    if request.param == "small batches":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
        monkeypatch.setattr(heatmap, "_CELLS", 300)
    made = heatmap.Targets(spark.createDataFrame(dots, POINTS), SIZE, SOURCE, SIGMA, REACH)
    return (made.cells() if request.param == "table" else made), _heats(dots)


def test_cells_and_maxima_match_plain_loops(heat):
    made, want = heat
    if isinstance(made, heatmap.Targets):
        got = {(r.image_id, r.row, r.col): r.v for r in made.cells().collect()}
        assert got == {(i, *at): v for i, cells in want.items() for at, v in cells.items()}
    top = {(i, *at) for i, cells in want.items() for at, v in cells.items() if v >= 0.2 and all(cells.get((at[0] + a, at[1] + b), 0.0) <= v for a in (-1, 0, 1) for b in (-1, 0, 1))}
    assert {(r.image_id, r.row, r.col) for r in heatmap.local_maxima(made, 0.2).collect()} == top


def test_peaks_match_plain_loops(heat):
    made, want = heat
    out = {}
    for i, cells in want.items():
        for at, v in sorted(((at, v) for at, v in cells.items() if v >= 0.3), key=lambda x: (-x[1], x[0])):
            if all(math.hypot(at[0] - r, at[1] - c) > 2.5 for r, c in out.get(i, [])):
                out.setdefault(i, []).append(at)
    got = heatmap.peaks(made, 0.3, 2.5).collect()
    assert {(r.image_id, r.rank, r.row, r.col) for r in got} == {(i, k + 1, *at) for i, some in out.items() for k, at in enumerate(some)}


def test_statistics_match_plain_loops(heat):
    made, want = heat
    got = {r.image_id: r for r in heatmap.heat_stats(made, SIZE * SIZE).collect()}
    assert set(got) == set(want)
    for i, cells in want.items():
        v, r = np.r_[list(cells.values()), np.zeros(SIZE * SIZE - len(cells))], got[i]
        assert (r.max, r.min, r.above_4) == (v.max(), v.min(), (v > 0.4).sum())
        assert (r.mean, r.std) == (pytest.approx(v.mean()), pytest.approx(v.std()))
        assert (r.row, r.col) == min(at for at, x in cells.items() if x == v.max())


def test_no_dot_images(heat, spark):
    made, want = heat
    ids = spark.createDataFrame([(i,) for i in (*range(5), 7, 9, 9)], "image_id bigint")
    r = populations.no_dot_false_positives(made, ids, SIZE).first()
    n = heatmap.local_maxima(made).groupBy("image_id").agg(F.count("*").alias("n")).collect()
    assert (r.n_images, r.n_false) == (7, 5) and r.mean_peaks == pytest.approx(sum(x.n for x in n if x.image_id is not None) / 7)
    tops = [min((-v, at) for at, v in cells.items())[1] for i, cells in want.items() if i is not None]
    assert (r.mean_y, r.mean_x) == (pytest.approx(sum(a for a, _ in tops) / 7 / SIZE), pytest.approx(sum(b for _, b in tops) / 7 / SIZE))


def test_sweep_matches_a_match_per_setting(heat, spark):
    made, want = heat
    truth = [(i, 1000 + k, float(x), float(y)) for i in (0, 1, 2, 6) for k, (x, y) in enumerate(np.random.default_rng(i).integers(0, 90, (12, 2)))]
    truth_df = spark.createDataFrame(truth, POINTS)
    got = populations.peak_sweep(made, truth_df, SOURCE / SIZE, (0.3, 0.95), (1.0, 4.0), 4.0, SIZE).collect()
    assert len(got) == 4
    cells = [(i, *at, v) for i, c in want.items() for at, v in c.items() if i is not None]
    for r in got:
        det = []
        for i in {c[0] for c in cells}:
            row, col, v = (np.array([c[k] for c in cells if c[0] == i]) for k in (1, 2, 3))
            det += [(i, int(row[k] * SIZE + col[k]), float(col[k] * SOURCE / SIZE), float(row[k] * SOURCE / SIZE)) for k in heatmap.suppressed(row, col, v, r.threshold, r.min_distance, SIZE)]
        m = matching.match_metrics(spark.createDataFrame(det, POINTS), truth_df, 4.0, empty_truth_recall=None).collect()
        assert {x.image_id for x in m} >= {0, 3, 6}
        # the image without an id has peaks and no truth
        assert r.recall == pytest.approx(np.mean([x.recall for x in m if x.recall is not None]))
        none = len([1 for c in want[None].values() if c >= r.threshold]) > 0
        assert r.precision == pytest.approx(sum(x.precision for x in m) / (len(m) + none))


@pytest.mark.parametrize("far", [0.0, 1.0, 2.5, 3.0, 40.0])
def test_suppressed_matches_distances(far):
    rng = np.random.default_rng(1)
    at = rng.choice(900, 300, replace=False)
    r, c, v = at // 30 - 5, at % 30, np.round(rng.random(300), 2)
    want = []
    for i in sorted(np.flatnonzero(v >= 0.2), key=lambda i: (-v[i], r[i] * 30 + c[i])):
        if all(np.hypot(r[i] - r[j], c[i] - c[j]) > far for j in want):
            want.append(i)
    assert heatmap.suppressed(r, c, v, 0.2, far, 30) == want


@pytest.mark.parametrize("name, exchanges", [("gaussian_heatmap", 1), ("local_maxima", 1), ("nms_peaks", 1), ("heat_statistics", 1), ("no_dot_false_positives", 5), ("peak_sweep", 7)])
def test_no_cell_is_shuffled(spark, name, exchanges):
    """Heatmaps have a hundred times the rows of their points: these meet before there are cells, and nothing multiplies rows below a shuffle."""
    with contextlib.redirect_stdout(io.StringIO()) as said:
        (CORE | REPORTS)[name](spark, "/root/testdata/sf0.001").explain()
    plan = said.getvalue()
    assert "Generate" not in plan and "Expand" not in plan and plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange rangepartitioning") <= exchanges
