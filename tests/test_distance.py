"""Exact nearest cells against plain search, on whole, sparse and split rasters."""

import numpy as np
import pytest

from cellgrove.operators import borders as B
from cellgrove.operators import distance as D
from cellgrove.session import cut


def search(wanted, y, x):
    return min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in zip(*np.nonzero(wanted)))


@pytest.mark.parametrize("band", [1 << 18, 20, 1])
@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_fill_and_distance(spark, grid, back, monkeypatch, band, share):
    monkeypatch.setattr(D, "BAND_CELLS", band)
    rng = np.random.default_rng(int(share * 100))
    v, m = rng.random((13, 19)), rng.random((13, 19)) < share
    m[4, 7], m[9, 0] = True, False
    df = grid({1: {"v": v, "m": m}, 2: {"v": v[:2, :3], "m": np.ones((2, 3), bool)}})
    filled, dist = back(D.fill_nearest(df, "v", "m", "f"), "f"), back(D.edge_distance(df, "m", "d"), "d")
    for y in range(13):
        for x in range(19):
            _, a, b = search(m, y, x)
            assert filled[y, x] == v[a, b]
            assert dist[y, x] == pytest.approx(search(~m, y, x)[0] ** 0.5)
    assert (back(D.edge_distance(df, "m", "d"), "d", 2) == np.inf).all()
    assert (back(D.fill_nearest(df, "v", "m", "v"), "v", 2) == v[:2, :3]).all()


def test_nothing_inside_keeps_values_and_sparse_cells(spark, grid):
    df = grid({3: {"v": np.arange(6.0).reshape(2, 3), "m": np.zeros((2, 3), bool)}})
    assert [r.f for r in D.fill_nearest(df, "v", "m", "f").orderBy("y", "x").collect()] == [0, 1, 2, 3, 4, 5]
    assert D.fill_nearest(df.limit(0), "v", "m", "f").count() == 0
    few = df.filter("x <> 1").selectExpr("image_id", "h", "w", "y", "x", "v", "x = 0 as m")
    got = {(r.y, r.x): r.d for r in D.edge_distance(few, "m", "d").collect()}
    assert got == {(0, 0): 2.0, (1, 0): 2.0, (0, 2): 0.0, (1, 2): 0.0}


@pytest.mark.parametrize("unit", [1, 10**12, 10**22])
def test_lower_envelope(unit):
    rng = np.random.default_rng(1)
    offsets = rng.integers(0, 60, (30, 25)).astype(object) * unit + rng.integers(0, max(2, min(unit, 1000)), (30, 25))
    offsets = offsets if unit > 10**15 else offsets.astype(np.int64)
    valid = rng.random((30, 25)) < 0.4
    valid[0] = False
    got = D.lower_envelope(offsets, valid, unit)
    for r in range(30):
        for x in range(25):
            cost = {i: unit * (x - i) ** 2 + int(offsets[r, i]) for i in range(25) if valid[r, i]}
            assert got[r, x] == -1 if not cost else cost[got[r, x]] == min(cost.values())


def test_payload_that_is_null_or_text(spark):
    df = spark.createDataFrame([(1, 1, 3, 0, x, t, m) for x, t, m in ((0, None, True), (1, "b", False), (2, "c", True))], "image_id long, h int, w int, y int, x int, t string, m boolean")
    assert [r.f for r in D.fill_nearest(df, "t", "m", "f").orderBy("x").collect()] == [None, None, "c"]


def shrunk(mask, attempts):
    """The first attempt that keeps enough, by plain search; a mask that fills its raster has no outside."""
    holes = np.argwhere(~mask)
    far = np.array([[((holes - (y, x)) ** 2).sum(1).min() ** 0.5 if len(holes) else np.inf for x in range(mask.shape[1])] for y in range(mask.shape[0])])
    for radius, share in attempts:
        left = mask & (far > radius)
        if left.sum() >= (1 if share is None else int(share * mask.sum())):
            return left
    return mask


def test_shrunk_masks_fall_back_by_what_is_left(spark, grid, back):
    y, x = np.mgrid[:44, :52]
    masks = {
        1: (y - 22) ** 2 + (x - 26) ** 2 <= 400,  # loses too much at the first radius
        2: (y >= 10) & (y < 34) & (x > 1) & (x < 50),
        3: (y == 20) & (x > 3),  # nothing would be left
        4: np.zeros((44, 52), bool),
        5: np.ones((44, 52), bool),
        6: (y > 0) & (x > 0),
    }
    df = grid({i: {"m": m} for i, m in masks.items()})
    df = cut(B.exclude_outer_line(B.suppress_border(B.outer_band(df, "m", "band"), "m", "a"), "m", "b"))
    got = {i: {c: back(df, c, i) for c in ("band", "a", "b")} for i in masks}
    for i, m in masks.items():
        # side 44: 18, 16 and 28, the least radii
        assert (got[i]["a"] == shrunk(m, [(18, 0.42), (9, None)])).all(), i
        assert (got[i]["b"] == shrunk(m, [(16, 0.55), (8, 0.42), (4, None)])).all(), i
        assert (got[i]["band"] == (m & ~shrunk(m, [(28, 0.0)]))).all(), i
