import itertools
import random

import pytest
from pyspark.sql import functions as F

from lineloom.functions import lattice
from lineloom.operators import selection


def random_motif(rng):
    return tuple(sorted(lattice.ordered(*(rng.randrange(-2, 3) for _ in range(4))) for _ in range(rng.randrange(0, 6))))


@pytest.mark.parametrize("seed", range(20))
def test_canonical_form_is_invariant(seed):
    m = random_motif(random.Random(seed))
    c = lattice.canonical(m)
    assert all(lattice.canonical(lattice.transformed(t, m)) == c for t in lattice.D4)
    t = lattice.first_transform(c, m)
    assert lattice.transformed(t, c) == m


def test_columns_agree_with_tuples(spark):
    rng = random.Random(1)
    motifs = [random_motif(rng) for _ in range(40)]
    df = spark.createDataFrame([(i, [list(e) for e in m]) for i, m in enumerate(motifs)], "i int, m array<array<int>>")
    df = df.withColumn("c", lattice.canonical_motif(F.col("m"))).withColumn("t", lattice.find_transform(F.col("c"), F.col("m"))).withColumn("s", lattice.motif_text(F.col("c")))
    for r in df.collect():
        c = lattice.canonical(motifs[r.i])
        assert tuple(map(tuple, r.c)) == c and r.t == lattice.first_transform(c, motifs[r.i])
        assert selection.parse(r.s) == c and selection.text_of(c) == r.s


def test_edge_shapes():
    h, v = ((0, 0, 1, 0),), ((0, 0, 0, 1),)
    assert lattice.canonical(h) == lattice.canonical(v)
    assert lattice.canonical(((0, 0, 0, 1), (0, 0, 1, 0))) != lattice.canonical(((-1, 0, 0, 0), (0, 0, 1, 0)))


def test_transforms_form_the_group():
    points = [(1, 2), (3, -1)]
    images = {t: [(p * x + q * y, r * x + s * y) for x, y in points] for t, (p, q, r, s) in lattice.D4.items()}
    assert len({tuple(i) for i in images.values()}) == 8
    assert images["rot90"] == [(-2, 1), (1, 3)]
    assert all(a != b for a, b in itertools.combinations(images.values(), 2))
