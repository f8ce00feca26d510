"""Many small rasters run stacked, with the results of each by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.operators import tiles as T
from cellgrove.operators.distance import edge_distance


def rasters(spark, n):
    """Rasters of two shapes, keyed by structs."""
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(8).alias("h"), F.lit(7).alias("w"))
    cells = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(6))))
    key = F.struct("id", F.lit("a").alias("variant")).alias("image_id")
    return cells.select(key, "h", "w", "y", "x", F.pmod(F.xxhash64("id", "y", "x"), F.lit(97)).cast("double").alias("v"))


def test_small_rasters_share_a_call(spark):
    df = rasters(spark, 1200).coalesce(1)
    deep = lambda b: {"o": (np.full(b.layers["v"][0].shape, b.layers["v"][0].size / (b.size[0] * b.size[1])), b.layers["v"][1])}
    made = T.run(df, ["v"], 1, deep, {"o": ""})
    assert made.count() == df.count() and made.agg(F.max("o")).first()[0] > 20


@pytest.mark.parametrize("border", T.BORDERS)
def test_stack_equals_its_parts(border):
    rng = np.random.default_rng(3)
    v, known = rng.integers(0, 9, (6, 8, 5)).astype(float), rng.random((6, 8, 5)) < 0.8
    v[1, 2, 3], known[..., 0] = np.nan, True
    known[..., 4] = False
    steps = [
        lambda b: b.correlate(b.layers["v"], [K.gaussian(0.8)], border)[0],
        lambda b: b.separable(b.layers["v"], K.gaussian_line(0.8), border),
        lambda b: b.extreme(b.layers["v"], K.ellipse(5), "min"),
        lambda b: b.extreme(b.layers["v"], K.ellipse(3), "max"),
        lambda b: b.median(b.layers["v"], 3, border),
        lambda b: b.median(b.layers["v"], 4, border),
        lambda b: b.median(b.layers["v"], 11, border),
    ]
    for fn in steps:
        values, valid = fn(T.Block({"v": (v, known)}, (0, 0), (6, 8)))
        for i in range(5):
            want, ok = fn(T.Block({"v": (v[..., i], known[..., i])}, (0, 0), (6, 8)))
            assert (valid[..., i] == ok).all()
            np.testing.assert_allclose(values[..., i][ok], want[ok], rtol=1e-12, atol=1e-12, equal_nan=True)


def test_distances_stay_within_their_raster(spark):
    df = rasters(spark, 60).withColumn("m", F.col("v") > 20).coalesce(1)
    got = edge_distance(df, "m", "d").select("image_id.id", "y", "x", "m", "d").toPandas()
    assert len(got) == df.count()
    for _, one in got.groupby("id"):
        out = one[~one["m"]][["y", "x"]].to_numpy()
        near = np.sqrt(((one[["y", "x"]].to_numpy()[:, None] - out[None]) ** 2).sum(-1)).min(1) if len(out) else np.full(len(one), np.inf)
        np.testing.assert_allclose(one["d"].to_numpy(), near)
