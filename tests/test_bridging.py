"""Pairs against a sequential run, lines cell by cell, and a gap that is closed."""

import numpy as np
import pytest

from cellgrove.operators import bridging as B


@pytest.mark.parametrize("levels", [3, 1000])
def test_pairs_are_those_of_a_sequential_run(spark, levels):
    rng = np.random.default_rng(levels)
    rows = []
    for image in range(4):
        pts = [(int(y), int(x)) for y, x in rng.integers(0, 12, (14, 2))]
        for a in sorted(set(pts)):
            for b in sorted(set(pts)):
                if a < b and rng.random() < 0.5:
                    rows.append((image, *a, *b, float(rng.integers(levels))))
    rows += [(9, 0, i, 0, i + 1, float(i)) for i in range(7)]  # a chain, one pair at a time
    want = set()
    for image in {r[0] for r in rows}:
        used = set()
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (r[5], r[1:5])):
            a, b = r[1:3], r[3:5]
            if a not in used and b not in used:
                used |= {a, b}
                want.add(r)
    got = B.greedy_pairs(spark.createDataFrame(rows, "image_id long, y0 int, x0 int, y1 int, x1 int, score double")).collect()
    assert len(got) == len(want) and {(r.image_id, r.y0, r.x0, r.y1, r.x1, r.score) for r in got} == want
    assert B.greedy_pairs(spark.createDataFrame([], "image_id long, y0 int, x0 int, y1 int, x1 int, score double")).count() == 0


def test_line_cells(spark):
    pairs = [(1, 2, 3, 2, 7), (2, 0, 0, 4, 4), (3, 5, 5, 1, 4), (4, 1, 1, 1, 1)]
    got = {}
    for r in B.line_cells(spark.createDataFrame(pairs, "image_id int, y0 int, x0 int, y1 int, x1 int")).collect():
        got.setdefault(r.image_id, []).append((r.y, r.x))
    assert sorted(got[1]) == [(2, x) for x in range(3, 8)]
    assert sorted(got[2]) == [(i, i) for i in range(5)]
    assert sorted(got[4]) == [(1, 1), (1, 1)]
    path = sorted(got[3])
    assert (1, 4) in path and (5, 5) in path and len(path) == 5 and all(b[0] - a[0] == 1 and abs(b[1] - a[1]) <= 1 for a, b in zip(path, path[1:]))


def test_gap_is_closed(spark, grid, back):
    m = np.zeros((9, 24), bool)
    m[4, 2:9] = m[4, 13:20] = True
    m[8, 10] = True
    v = np.where(np.arange(24)[None, :] > 0, 0.5, 0.1) * np.ones((9, 1))
    df = grid({1: {"m": m, "v": v, "s": v, "fov": np.ones_like(m)}})
    got = back(B.connect_ends(df, "m", "v", "s", "fov", "o"), "o").astype(bool)
    want = m.copy()
    want[4, 9:13] = True
    assert (got == want).all()
