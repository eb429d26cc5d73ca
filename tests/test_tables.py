import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.operators import heatmap, matching, stats
from lineloom.sources import sinks, traces

POINTS = "image_id int, idx bigint, x double, y double"


def test_match_conventions(spark):
    det = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 50.0, 50.0), (2, 1, 0.0, 0.0), (4, 1, 6.0, 0.0)], POINTS)
    truth = spark.createDataFrame([(1, 1, 3.0, 4.0), (3, 1, 0.0, 0.0), (4, 1, 0.0, 0.0)], POINTS)
    got = {r.image_id: (r.precision, r.recall, r.f1) for r in matching.match_metrics(det, truth, 6.0).collect()}
    assert got[1] == (0.5, 1.0, pytest.approx(2 / 3))
    assert got[2] == (0.0, 1.0, 0.0) and got[3] == (1.0, 0.0, 0.0)
    assert got[4] == (0.0, 0.0, 0.0)  # a distance of exactly the tolerance is no match
    none = {r.image_id: r.recall for r in matching.match_metrics(det, truth, 6.0, empty_truth_recall=None).collect()}
    assert none[2] is None and none[1] == 1.0


@pytest.mark.parametrize("tol", [3.0, 7.5])
def test_buckets_equal_brute_force(spark, tol):
    rng = np.random.default_rng(3)
    a = [(int(k % 3), k, *map(float, rng.integers(-40, 40, 2))) for k in range(150)]
    b = [(int(k % 3), k, *map(float, rng.integers(-40, 40, 2))) for k in range(120)]
    got = {(r.idx, r.other) for r in matching.close_pairs(spark.createDataFrame(a, POINTS), spark.createDataFrame(b, POINTS), tol).collect()}
    assert got == {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and np.hypot(p[2] - q[2], p[3] - q[3]) < tol}


def test_one_to_one_takes_in_order(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 2.0, 0.0)], POINTS)
    b = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, 3.0, 0.0)], POINTS)
    assert {(r.idx, r.other) for r in matching.one_to_one(a, b).collect()} == {(1, 7), (2, 8)}


def test_spacing_and_components(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 30.0, 0.0), (2, 1, 5.0, 5.0)], POINTS)
    got = {r.image_id: (r.spacing, r.radius) for r in matching.dot_radius(p, 100.0).collect()}
    assert got == {1: (10.0, 3.0), 2: (None, 5.0)}
    m = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 1, 7), (1, 2, 5)], "image_id int, component int, hub int")
    assert {(r.a, r.b) for r in matching.component_pairs(m).collect()} == {(5, 6), (5, 7), (6, 7)}


def test_peaks(spark):
    heat = spark.createDataFrame([(1, 10, 12, 0.9), (1, 10, 13, 0.7), (1, 3, 3, 0.5), (1, 4, 4, 0.1)], "image_id int, row int, col int, v double")
    got = [(r.row, r.col) for r in heatmap.peaks(heat, 0.4, 3.0).orderBy("rank").collect()]
    assert got == [(10, 12), (3, 3)]
    assert {(r.row, r.col) for r in heatmap.local_maxima(heat).collect()} == {(10, 12), (3, 3)}


def test_separable_targets(spark):
    p = spark.createDataFrame([(1, k, 20.0 + 60 * (k % 14), 20.0 + 60 * (k // 14)) for k in range(180)], POINTS)
    assert heatmap.local_maxima(heatmap.gaussian(p, 128, 900.0)).count() >= 180


def test_otsu(spark):
    rng = np.random.default_rng(1)
    gray = np.concatenate([rng.integers(20, 60, 400), rng.integers(180, 230, 600)])
    rows = [(1, int(g), int(n)) for g, n in zip(*np.unique(gray, return_counts=True))]
    t = heatmap.otsu(spark.createDataFrame(rows, "image_id int, gray int, n bigint")).first().threshold
    assert gray[gray < 100].max() <= t < 180


def test_search_pages_and_splits(spark):
    df = spark.range(400).select(F.col("id"))
    assert {r.id for r in stats.search(df, " 39 ").collect()} == {i for i in range(400) if "39" in str(i) or f"pattern-{i - 1}".find("39") >= 0}
    assert stats.search(df, "  ").count() == 400 and stats.search(df, "PATTERN 12").count() == 11
    assert [r.id for r in stats.page(df, "id", 2).collect()] == list(range(36, 72))
    parts = {r.part: r.n for r in stats.hash_split(df, "id", {"train": 8, "val": 1, "test": 1}).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 400 and set(parts) == {"train", "val", "test"} and parts["train"] > 250
    one = spark.range(1).select(stats.decide(F.lit(0.9), F.lit(0.8), F.lit(0.0), F.lit(0.3), F.lit(1.0), 2.0).alias("d"))
    assert one.first().d is True  # a rate of 0.0 is a rate


def test_wide_file(spark, tmp_path):
    path = tmp_path / "k.csv"
    rows = [(1, 0, 5, 5), (2, 1, 6, 5), (2.5, 2, "", 7)]
    path.write_text("x-kolam 2,y-kolam 2,x-kolam 10,y-kolam 10\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    assert traces.pattern_ids(spark, str(path)) == [2, 10]
    got = traces.read_wide(spark, str(path), "c").collect()
    assert [(r.pattern_id, r.step, r.x, r.y) for r in sorted(got, key=lambda r: (r.pattern_id, r.step))] == [(2, 0, 1.0, 0.0), (2, 1, 2.0, 1.0), (2, 2, 2.5, 2.0), (10, 0, 5.0, 5.0), (10, 1, 6.0, 5.0)]
    cat = traces.Catalog({"c": str(path)})
    assert cat.traces(spark, "c", [2]).count() == 3
    with pytest.raises(ValueError):
        cat.path("none")


def test_truth_documents(spark, tmp_path):
    doc = {"kolam_number": 1, "n_nodes": 2, "dot_pixel_positions": {"0,1": [10.0, 20.0], "-1,0": [5.0, 6.0]}, "edges": [[[0, 1], [-1, 0]], [[-1, 0], [0, 1]]], "degradation": {"contrast": 1.5}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    t = traces.read_truth(spark, str(tmp_path))
    assert [(r.image_id, r.idx, r.lx, r.ly, r.x) for r in traces.truth_points(t).orderBy("idx").collect()] == [("a", 0, -1, 0, 5.0), ("a", 1, 0, 1, 10.0)]
    assert [tuple(r) for r in traces.truth_edges(t).collect()] == [("a", -1, 0, 0, 1, 2)]
    sinks.write_metrics(t.select("image_id", "n_nodes"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().n_nodes == "2"


def test_lattice_and_uploaded(spark):
    assert traces.lattice(spark, 4, 3).count() == 12
    node = spark.createDataFrame([(2, 1), (0, 5)], "x int, y int")
    assert [(r.step, r.x, r.y) for r in traces.as_pattern(node).orderBy("step").collect()] == [(0, 0.0, 5.0), (1, 2.0, 1.0)]
