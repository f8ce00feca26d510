"""Hull areas against all-pairs half planes."""

import numpy as np
import pytest

from cellgrove.operators.hulls import hull_areas


def area(points):
    """Gift wrapping, then the shoelace formula."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return 0.0
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    hull, at = [], pts[0]
    while True:
        hull.append(at)
        best = pts[0] if pts[0] != at else pts[1]
        for p in pts:
            c = cross(at, best, p)
            far = lambda q: (q[0] - at[0]) ** 2 + (q[1] - at[1]) ** 2
            if p != at and (c < 0 or (c == 0 and far(p) > far(best))):
                best = p
        at = best
        if at == hull[0]:
            break
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2


@pytest.mark.parametrize("seed", range(3))
def test_hull_areas(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for comp in range(25):
        n = int(rng.integers(1, 60))
        pts = {(int(y), int(x)) for y, x in zip(rng.normal(20, 6, n), rng.normal(30, 1 + comp, n))}
        rows += [(1, y, x, comp) for y, x in pts]
        want[comp] = area(pts)
    rows += [(2, 5, x, 7) for x in range(9)] + [(2, y, y, 8) for y in range(9)] + [(2, 0, 0, None)]
    want_2 = {7: 0.0, 8: 0.0}
    got = hull_areas(spark.createDataFrame(rows, "image_id long, y int, x int, comp long"), "comp").collect()
    assert {r.comp: r.hull_area for r in got if r.image_id == 1} == want
    assert {r.comp: r.hull_area for r in got if r.image_id == 2} == want_2
