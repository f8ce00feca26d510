"""Planted circles are found, and the blob at a circle's centre goes, alone."""

import numpy as np
from pyspark.sql import functions as F

from cellgrove.operators import circles as C
from cellgrove.session import cut


def test_planted_circles_are_found(spark, grid):
    y, x = np.mgrid[:64, :72]
    planted = {1: (30, 40, 14), 2: (20, 22, 11), 3: (40, 30, 17)}
    rng = np.random.default_rng(2)
    images = {i: {"v": 1 / (1 + np.exp((np.hypot(y - a, x - b) - r) / 0.7)) + 0.02 * rng.random(y.shape)} for i, (a, b, r) in planted.items()}
    images[4] = {"v": np.zeros((64, 72))}
    edges = cut(C.thin_edges(grid(images), "v", 0.4, 1.2))
    on = edges.filter("edge").groupBy("image_id").count().collect()
    assert {r.image_id for r in on} == {1, 2, 3}
    # one cell thick: about as many as the circle is long
    assert all(0.6 <= r["count"] / (2 * np.pi * planted[r.image_id][2]) <= 1.3 for r in on)
    best = {r.image_id: r for r in C.circle_peaks(C.circle_votes(edges, list(range(8, 22, 3))), 3).filter("rank = 1").collect()}
    for i, (a, b, r) in planted.items():
        assert abs(best[i].cy - a) <= 1 and abs(best[i].cx - b) <= 1 and best[i].r == r


def test_one_compact_blob_goes(spark, grid, back):
    y, x = np.mgrid[:60, :60]
    blob, line = np.hypot(y - 30, x - 32) <= 3, (y == 40) & (x > 10)
    far = np.hypot(y - 6, x - 6) <= 3
    both = blob | line | far
    df = grid({1: {"m": both}, 2: {"m": line}, 3: {"m": both}, 4: {"m": both}})
    found = spark.createDataFrame(
        # image 3: the first circle has nothing but the line around it
        [(1, 1, 31, 31), (1, 2, 6, 6), (2, 1, 31, 31), (3, 1, 58, 55), (3, 2, 31, 31)],
        "image_id long, rank int, cy int, cx int",
    )
    out = cut(C.drop_at_circles(df, "m", found, "left", half=12, area=(12, 100), reach=8.0))
    assert out.count() == df.count()
    for i, want in {1: line | far, 2: line, 3: line | far, 4: both}.items():
        assert (back(out, "left", i) == want).all(), i
    assert C.drop_at_circles(df.limit(0), "m", found, "left").count() == 0
    assert out.filter(F.col("left").isNull()).isEmpty()
