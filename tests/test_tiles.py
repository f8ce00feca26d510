"""Stencils on tiles against plain windows, over split rasters, gaps and every border."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.operators import tiles as T

PAD = {"reflect": "symmetric", "reflect101": "reflect", "replicate": "edge"}


def windows(v, known, taps, border):
    """Values under each window (dict of place -> list), cells that are unknown left out."""
    r = max(max(abs(a), abs(b)) for a, b in taps)
    n, m = v.shape
    pad = lambda a, fill: np.pad(a, r, constant_values=fill) if border == "constant" else np.pad(a, r, mode=PAD[border])
    pv, pk = pad(v, 0), pad(known, False)
    return {(y, x): [(t, pv[y + r + t[0], x + r + t[1]]) for t in taps if pk[y + r + t[0], x + r + t[1]]] for y in range(n) for x in range(m)}


def block(v, known, tile, reach):
    """The raster in blocks as ``run`` makes them, and a way to put own cells together."""
    h, w = v.shape
    for ty in range(-(-h // tile)):
        for tx in range(-(-w // tile)):
            y0, x0 = max(0, ty * tile - reach), max(0, tx * tile - reach)
            y1, x1 = min(h, (ty + 1) * tile + reach), min(w, (tx + 1) * tile + reach)
            own = np.s_[ty * tile - y0 : min(h, (ty + 1) * tile) - y0, tx * tile - x0 : min(w, (tx + 1) * tile) - x0]
            put = np.s_[ty * tile : min(h, (ty + 1) * tile), tx * tile : min(w, (tx + 1) * tile)]
            yield T.Block({"v": (v[y0:y1, x0:x1], known[y0:y1, x0:x1])}, (y0, x0), (h, w)), own, put


def on_blocks(v, known, tile, reach, fn):
    out, got = np.zeros(v.shape), np.zeros(v.shape, bool)
    for b, own, put in block(v, known, tile, reach):
        values, valid = fn(b)
        out[put], got[put] = values[own], valid[own]
    return out, got


def check(v, known, taps, border, tile, fn, rule):
    reach = max(max(abs(a), abs(b)) for a, b in taps)
    out, got = on_blocks(v, known, tile, reach, fn)
    for (y, x), members in windows(v, known, taps, border).items():
        assert got[y, x] == bool(members)
        if members:
            np.testing.assert_allclose(out[y, x], rule(members), rtol=1e-12, atol=1e-12, equal_nan=True)


def raster(seed, shape=(11, 14), gaps=0.0, levels=None):
    rng = np.random.default_rng(seed)
    v = rng.random(shape) if levels is None else rng.integers(0, levels, shape).astype(float)
    return v, rng.random(shape) >= gaps


@pytest.mark.parametrize("border", [*PAD, "constant"])
@pytest.mark.parametrize("tile,gaps", [(100, 0.0), (4, 0.0), (5, 0.3), (6, 0.97), (100, 1.0)])
def test_correlate_and_median(border, tile, gaps):
    v, known = raster(1, gaps=gaps)
    if border == "reflect101":
        taps = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    else:
        taps = [(a, b) for a in range(-4, 4) for b in range(-4, 4)]  # an even window
    kernel = {t: 1.0 + t[0] - 0.3 * t[1] for t in taps}
    check(v, known, taps, border, tile, lambda b: b.correlate(b.layers["v"], [{(0, 0): 2.0}, kernel], border)[1], lambda ms: sum(kernel[t] * x for t, x in ms))
    v, known = raster(2, gaps=gaps, levels=6)
    odd = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    check(v, known, odd, border, tile, lambda b: b.median(b.layers["v"], 5, border), lambda ms: np.median([x for _, x in ms]))


@pytest.mark.parametrize("kind", ["min", "max"])
@pytest.mark.parametrize("element", [K.ellipse(7), K.line_element(9, 30), K.line_element(9, 0), K.line_element(7, 90), K.square(5), [(0, 0)], [(-3, 2), (1, -4), (1, -2), (1, -1)]], ids=range(7))
def test_extremes(kind, element):
    for gaps, tile in ((0.0, 100), (0.0, 4), (0.4, 5)):
        v, known = raster(3, gaps=gaps)
        v[2, 3], v[5, 5:9] = np.nan, np.nan
        order = lambda x: (np.isnan(x), x)
        rule = lambda ms: (min if kind == "min" else max)((x for _, x in ms), key=order)
        check(v, known, [tuple(t[:2]) for t in element], "constant", tile, lambda b: b.extreme(b.layers["v"], [tuple(t[:2]) for t in element], kind), rule)


def test_running_extreme_is_the_window():
    v = np.random.default_rng(4).random((3, 50))
    for width in (1, 2, 7, 31, 50):
        want = np.lib.stride_tricks.sliding_window_view(v, width, axis=1).min(-1)
        assert (T.running_extreme(v, width, 1, "min") == want).all()


def test_chain_on_split_rasters(spark, grid, back):
    rng = np.random.default_rng(5)
    images = {1: {"v": rng.random((21, 17)), "m": rng.random((21, 17)) < 0.5}, 2: {"v": rng.random((3, 2)), "m": np.ones((3, 2), bool)}}
    line = {d: 1 / 5 for d in range(-2, 3)}

    def chain(b):
        smooth = b.separable(b.layers["v"], line, "reflect")
        return {"s": smooth, "lo": b.extreme(smooth, K.ellipse(3), "min"), "m": b.extreme(b.layers["m"], K.ellipse(3), "max")}

    df = grid(images).withColumn("note", F.lit("x"))
    whole = T.run(df, ["v", "m"], 3, chain, {"s": "", "lo": "", "m": "m"})
    split = T.run(df, ["v", "m"], 3, chain, {"s": "", "lo": "", "m": "m"}, tile=4)
    assert split.columns == ["image_id", "h", "w", "y", "x", "v", "note", "s", "lo", "m"] and dict(split.dtypes)["m"] == "boolean"
    assert split.count() == whole.count() == 21 * 17 + 6
    for i in (1, 2):
        for c in ("s", "lo", "m"):
            a, b = back(whole, c, i), back(split, c, i)
            assert np.allclose(a.astype(float), b.astype(float))
        p = np.pad(images[i]["v"], 2, mode="symmetric")
        n, m = images[i]["v"].shape
        want = sum(p[a : a + n, b : b + m] for a in range(5) for b in range(5)) / 25
        assert np.allclose(back(split, "s", i).astype(float), want)


def test_rows_shuffled_do_not_grow_with_the_windows(spark):
    """Three chained stencils of width 31 on 256 x 256: under 1.5 rows a cell and stage."""
    df = spark.range(0, 256 * 256).selectExpr("1L as image_id", "512 as h", "512 as w", "int(id div 256) as y", "int(id % 256) as x")
    reach, tile = 45, 256
    rows = df.withColumn("_ty", T._tiles("y", "h", reach, tile)).withColumn("_tx", T._tiles("x", "w", reach, tile)).count()
    assert rows / (256 * 256) < 1.5
    plan = T.run(df.withColumn("v", F.lit(1.0)), ["v"], reach, lambda b: {"o": b.layers["v"]}, {"o": ""})
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
