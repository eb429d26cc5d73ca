import numpy as np
import pytest

from lineloom.operators import image


def blobs(places, size=400, step=70, radius=9, lines=()):
    y, x = np.mgrid[:size, :size]
    gray = np.full((size, size), 230, np.uint8)
    at = [(60 + step * px, 60 + step * py) for px, py in places]
    for cx, cy in at:
        gray[(x - cx) ** 2 + (y - cy) ** 2 <= radius**2] = 20
    for i, j in lines:
        (x0, y0), (x1, y1) = at[i], at[j]
        for t in np.linspace(0, 1, 400):
            cx, cy = round(x0 + t * (x1 - x0)), round(y0 + t * (y1 - y0))
            gray[cy - 1 : cy + 2, cx - 1 : cx + 2] = 20
    return gray


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_dots_have_no_places(n):
    gray = blobs([(0, 0), (1, 0), (2, 0), (0, 1), (1, 1)][:n])
    a = image.analyse(gray)
    assert len(a["dots"]) == n and len(a["places"]) == (5 if n == 5 else 0)
    assert len({tuple(p) for p in a["places"]}) == len(a["places"])


def test_square_with_perimeter():
    a = image.analyse(blobs([(0, 0), (1, 0), (0, 1), (1, 1)], lines=[(0, 1), (1, 3), (3, 2), (2, 0)]))
    assert a["edges"] == [(0, 1), (0, 2), (1, 3), (2, 3)]


def test_distance_is_euclidean():
    rng = np.random.default_rng(0)
    mask = rng.random((15, 18)) < 0.8
    got = image.distance(mask)
    paper = np.argwhere(~np.pad(mask, 1)) - 1
    want = np.array([[np.sqrt(((paper - [y, x]) ** 2).sum(1)).min() if mask[y, x] else 0.0 for x in range(18)] for y in range(15)])
    assert np.allclose(got, want)


def test_rotation_round_trip():
    p = np.array([[10.0, 20.0], [30.0, 5.0]])
    assert np.allclose(image.rotate_points(image.rotate_points(p, 17.0, (50, 60)), 17.0, (50, 60), back=True), p)


def test_contract():
    with pytest.raises(image.ContractError):
        image.assert_conforms(np.zeros((3, 2)), np.zeros((2, 2)), 1.0)
    with pytest.raises(image.ContractError):
        image.assert_conforms(np.zeros((2, 2)), np.zeros((2, 2)), 1.0)
    image.assert_conforms(np.zeros((2, 2)), np.zeros((0, 2)), 0.0)


def test_images_in_a_table(spark):
    g = blobs([(0, 0), (1, 0), (0, 1), (1, 1)], lines=[(0, 1)])
    df = spark.createDataFrame([(1, 400, 400, bytearray(g.tobytes())), (2, 5, 5, bytearray(b"x"))], "image_id int, height int, width int, gray binary")
    rows = image.graphs(df).collect()
    assert sum(r.kind == "dot" for r in rows if r.image_id == 1) == 4
    assert [(r.idx, r.other) for r in rows if r.kind == "edge"] == [(0, 1)]
    assert [r.image_id for r in rows if r.kind == "error"] == [2]
