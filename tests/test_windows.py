"""Small rasters of known size take windows over the image; the results are those of the joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import components as P
from cellgrove.operators import contrast as X
from cellgrove.operators import masked as M
from cellgrove.operators import shapes as S
from cellgrove.operators import threshold as G
from cellgrove.operators.cells import to_cells
from cellgrove.operators.equalise import clahe
from cellgrove.operators.skeleton import thin
from cellgrove.plans import presets
from cellgrove.plans.recipe import run_recipe, step


@pytest.fixture(scope="module")
def small(spark):
    noise = lambda a: (F.pmod(F.xxhash64("id", "i"), F.lit(a)) / a).cast("double")
    rows = spark.range(40).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(62))))
    arrays = rows.groupBy(F.col("id").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", (F.when(F.col("id") == 7, 0.5).otherwise(noise(89))).alias("v")))), lambda s: s["v"]).alias("embedding")
    )
    cells = to_cells(arrays, "vec_id", "embedding", 9, 7, "n")
    edge = ~(F.col("y").isin(0, 6) & F.col("x").isin(0, 8)) & (F.col("image_id") != 3)
    return cells.withColumns({"fov": edge, "g": F.floor(F.col("n") * 255).cast("double"), "s": 1 - F.col("n"), "c": F.abs(F.col("n") - 0.5) * 2, "m": F.col("n") > 0.6})


STEPS = {
    "normalise": lambda d: M.normalise(d, "n", "fov", "o"),
    "masked": lambda d: M.normalise(d, "n", "fov", "o", "masked"),
    "floor": lambda d: M.percentile_floor(d, "n", "fov", "o", 0.4, 0.98, 0.9),
    "fill_median": lambda d: M.fill_median(d, "n", "fov", "o"),
    "active": lambda d: M.with_active(d, {"o": ("n", 0.8), "p": ("s", 0.4)}, "fov"),
    "noise": lambda d: M.with_noise_strength(d, "n", "s", "c", "fov", "o"),
    "flatten": lambda d: X.flatten(d, "g", "n", "fov", "subtract", "o"),
    "clahe": lambda d: clahe(d, "g", 4.0, (2, 2), "o"),
    "clahe_padded": lambda d: clahe(d, "g", 2.5, (3, 4), "o"),
    "label": lambda d: P.label(d, "m", "o", 4),
    "thin": lambda d: thin(d, "m", "o"),
    "drop_border": lambda d: P.drop_border(P.label(d, "m"), 1, "o"),
    "top_k": lambda d: P.top_k(P.label(d, "m"), 2, "o"),
    "largest": lambda d: P.largest(P.label(d, "m", conn=4), "o"),
    "fill_holes": lambda d: P.fill_holes(d, "m", "o"),
    "threshold": lambda d: G.threshold(d, "n", "fov", "percentile", 0.2, "o"),
    "density": lambda d: G.density_hysteresis(d, "n", "fov", "o", 0.1),
    "levels": lambda d: G.connected_levels(d, "n", "fov", "o", 0.9, 0.7, 3, "s", 0.1),
    "evidence": lambda d: G.evidence_hysteresis(d, "n", "c", "fov", "o"),
    "local": lambda d: G.local_adaptive(d, "n", "s", "fov", "o", 3),
    "blobs": lambda d: S.suppress_blobs(d, "n", "s", "c", "fov", "o", 3, 5),
    "clean": lambda d: S.clean_noise(d, "m", "n", "s", "c", "fov", "o", 5, 1, (2, 2, 1.5)),
    "tree": lambda d: S.near_tree(d, "m", "c", "s", "n", "fov", "o", radius=1),
    "grow": lambda d: S.grow_region(d, "m", "fov", "n", "s", "fov", "o", 3),
    "recover": lambda d: S.recover_components(d, "m", "n", "fov", "o", 1.2, 2, 0.6, 2),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_windows_give_what_the_joins_give(small, name):
    made = STEPS[name](small)
    joined = STEPS[name](small.withColumn("h", F.col("h") + 0))  # the bound is lost
    new = [c for c in made.columns if c not in small.columns]
    keys = ["image_id", "y", "x"]
    read = lambda d: d.select(*keys, *[F.col(c).cast("double") for c in new]).toPandas().sort_values(keys)
    a, b = read(made), read(joined)
    assert new and len(a) == len(b) > 0
    np.testing.assert_allclose(a[new].to_numpy(), b[new].to_numpy(), rtol=1e-12, atol=1e-12)


def test_a_chain_of_statistics_reads_its_input_once(small):
    steps = [
        step("normalise", "a", value="n", mask="fov"),
        step("active_mask", "b", value="a", mask="fov", p=0.8),
        step("min_area", "d", mask="b", n=3),
        step("shape_clean", "e", mask="d", area=4),
        step("density_hysteresis", "f", value="a", mask="fov", density=0.1),
    ]
    text = run_recipe(small, steps, ["e", "f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "parquet" not in text and text.count("Generate posexplode") == 1


def test_soft_response_stores_nothing(small):
    photo = small.select("image_id", "h", "w", "y", "x", "fov", F.col("g").alias("green"))
    made = run_recipe(photo, presets.soft_response(presets.SMALL), ["soft"])
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "parquet" not in text
    assert made.count() == small.count()


def test_histograms_hold_no_empty_bins(small):
    assert G.histogram(small, F.col("n"), 256).groupBy("image_id").count().agg(F.max("count")).first()[0] <= 63


@pytest.mark.parametrize("power", [3.0, 0.3])
def test_triangle_over_held_bins_is_that_over_all(small, power):
    bins, skew = 64, small.withColumn("t", F.pow("n", F.lit(power)))
    got = {r.image_id: r.cutoff for r in G.triangle_cutoff(skew, F.col("t"), bins=bins).collect()}
    for image, rows in skew.select("image_id", "t").toPandas().groupby("image_id"):
        v = rows["t"].to_numpy()
        lo, hi = v.min(), v.max()
        at = np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1).astype(int) if hi > lo else np.zeros(len(v), int)
        c = np.bincount(at, minlength=bins)
        peak, held = int(c.argmax()), np.flatnonzero(c)
        right = peak - held[0] < held[-1] - peak
        width = held[-1] - peak if right else peak - held[0]
        along = held[-1] - np.arange(bins) if right else np.arange(bins) - held[0]
        below = np.round((c.max() * along - width * c) / np.hypot(c.max(), width), 9)
        tried = [(below[b], -along[b], b) for b in range(bins) if 0 <= along[b] < width]
        want = lo + (max(tried)[2] + 0.5) * (hi - lo) / bins if tried else None
        assert got[image] == (want if want is None else pytest.approx(want))


def test_steps_share_the_partitions_of_an_image(small):
    steps = [
        step("normalise", "a", value="n", mask="fov"),
        step("edge_distance", "e", mask="fov"),
        step("sql", "b", text="a > 0.6"),
        step("min_area", "d", mask="b", n=3),
        step("dilate", "f", value="d", element=[(0, 0), (0, 1)]),
    ]
    text = run_recipe(small, steps, ["e", "f"])._jdf.queryExecution().executedPlan().toString()
    # one before the distances, one after them for the labels, one after those for all that follows
    assert text.count("Exchange hashpartitioning") <= 3 + ("REPARTITION_BY_NUM" in text)
