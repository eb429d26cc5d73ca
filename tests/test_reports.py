import math

import pytest
from pyspark.sql import functions as F

from lineloom.functions.lattice import motif_of_text, motif_text
from lineloom.operators import generate, heatmap, populations, reports, selection

from test_graph import GRAPHS, SQUARE, cycle, frames

POINTS = "image_id int, idx bigint, x double, y double"


def test_pair_scores_follow_strands(spark):
    truth = frames(spark, {1: ([], {(0, 0, 1, 0): 2, (1, 0, 2, 0): 1}), 2: ([], {(0, 0, 1, 0): 1})})[1]
    found = frames(spark, {1: ([], {(0, 0, 1, 0): 3, (5, 5, 6, 5): 1}), 3: ([], {(0, 0, 1, 0): 1})})[1]
    got = {r.pattern_id: (r.precision, r.recall, r.strand_precision, r.strand_recall) for r in reports.pair_scores(truth, found).collect()}
    assert got == {1: (0.5, 0.5, 0.5, 0.6667), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0, 1.0)}


def test_structure_of_a_doubled_square(spark):
    node, _ = frames(spark, {1: ([], cycle(SQUARE)), 2: ([(9, 9)], cycle(SQUARE))})
    motif = F.array(*[F.array(*map(F.lit, e)) for e in sorted(cycle(SQUARE))])
    placed = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 0, 0)], "pattern_id int, x int, y int").select("*", motif.alias("motif"), F.lit("identity").alias("transform"))
    made = generate.structure(placed, node)
    assert {(r.pattern_id, r.mult) for r in made["edge"].collect()} == {(1, 2), (2, 1)}
    assert {r.pattern_id: r.single_stroke for r in made["validity"].collect()} == {1: True, 2: False}
    assert made["trail"].where("pattern_id = 1").count() == 9 and made["trail"].where("pattern_id = 2").count() == 0


def test_motif_text_round_trip(spark):
    df = spark.createDataFrame([([[0, 0, 0, 1], [-1, 0, 0, 0]],), ([],)], "m array<array<int>>")
    assert all(r.m == r.back for r in df.withColumn("back", motif_of_text(motif_text(F.col("m")))).collect())


def test_representatives_and_populations(spark):
    d = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (5, 500)], "image_id int, n int")
    assert {r.image_id: r.roles for r in populations.representatives(d, "n", "image_id", 300).collect()} == {1: "lowest", 3: "middle", 5: "highest"}
    kind = d.select(populations.population(F.col("image_id"), [1], [2]).alias("k")).collect()
    assert [r.k for r in kind] == ["excluded", "in_scope", "no_dots", "no_dots", "no_dots"]


def test_nearest_distances_at_any_reach(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 500.0, 0.0), (2, 3, 1.0, 1.0)], POINTS)
    b = spark.createDataFrame([(1, 9, 3.0, 4.0)], POINTS)
    assert {r.idx: r.dist for r in populations.nearest_distances(a, b, 10.0).collect()} == {1: 5.0, 2: pytest.approx(math.hypot(497, 4)), 3: None}


def test_heat_counts_absent_cells(spark):
    heat = spark.createDataFrame([(1, 0, 0, 1.0), (1, 2, 3, 0.5)], "image_id int, row int, col int, v double")
    r = heatmap.heat_stats(heat, 16).first()
    assert (r.mean, r["min"], r["max"], r.above_4, r.row, r.col) == (1.5 / 16, 0.0, 1.0, 2, 0, 0) and r.std == pytest.approx(math.sqrt(1.25 / 16 - (1.5 / 16) ** 2))


def test_a_scoring_strategy_is_the_callers():
    task = selection.Task({(x, 0) for x in range(9)}, selection.Counter({(1, 0, 2, 0): 1}), {1: [((1, 0), "0,0>1,0", "identity")]})
    assert selection.budgeted_select(task)[0] == []
    assert len(selection.budgeted_select(task, bonus=lambda new, degree: 100)[0]) == 1


def test_corrections_of_failed_patterns(spark):
    node, edge = frames(spark, GRAPHS)
    r = reports.correction_report(generate.diagnoses(node, edge), node).first()
    assert (r.n_patterns, r.n_failed, r.max_corrections, r.n_in_parts) == (8, 2, 2, 1)
