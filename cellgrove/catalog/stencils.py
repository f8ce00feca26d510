"""Stencil queries (section F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import (
    CELLS,
    MASKED,
    U8,
    cells,
    masked_cells,
    pick,
    rounded,
    taps_of,
    u8_cells,
    window_sql,
)
from cellgrove.functions import kernels as K
from cellgrove.operators import equalise as Q
from cellgrove.operators import filters as T
from cellgrove.operators import morphology as R
from cellgrove.operators import neighbourhood as N
from cellgrove.operators.distance import edge_distance

GAUSS = K.gaussian(0.8, radius=2)


@query(
    "F1_correlate_gaussian_reflect",
    f"WITH {CELLS} " + window_sql("cells", taps_of(GAUSS), "reflect", "round(sum(n.v * k.w0), 6) + 0.0 AS g"),
)
def _(read):
    return pick(N.correlate(cells(read), "v", GAUSS, "reflect", "g"), "g")


@query(
    "F1_separable_box",
    f"WITH {CELLS} " + window_sql("cells", taps_of(K.box(5)), "reflect", "round(sum(n.v * k.w0), 6) + 0.0 AS b"),
)
def _(read):
    return pick(T.box(cells(read), "v", 5, "reflect", "b"), "b")


@query(
    "F1_sobel_reflect101",
    f"WITH {CELLS} "
    + window_sql(
        "cells",
        taps_of(K.sobel("x"), K.sobel("y")),
        "reflect101",
        "round(sum(n.v * k.w0), 6) + 0.0 AS gx, round(sum(n.v * k.w1), 6) + 0.0 AS gy",
    ),
)
def _(read):
    return pick(T.gradient(cells(read), "v", "gx", "gy"), "gx", "gy")


DOG = K.difference(K.gaussian(0.6, radius=2), K.gaussian(1.0, radius=2))


@query(
    "F1_correlate_dog_constant",
    f"WITH {CELLS} " + window_sql("cells", taps_of(DOG), "constant", "round(sum(n.v * k.w0), 6) + 0.0 AS d"),
)
def _(read):
    return pick(N.correlate(cells(read), "v", DOG, "constant", "d"), "d")


def bank_sql(bank):
    sums = ", ".join(f"sum(n.v * k.w{i})" for i in range(len(bank)))
    return f"WITH {CELLS} " + window_sql("cells", taps_of(*bank), "reflect", f"round(greatest(0.0, {sums}), 6) AS r")


GABORS = [K.gabor(5, 1.5, a, 3.0, 0.5) for a in (0, 45, 90, 135)]
LINES = [K.matched_line(5, 0.6, a) for a in (0, 30, 60, 90, 120, 150)]


@query("F2_gabor_bank", bank_sql(GABORS))
def _(read):
    return pick(T.filter_bank_max(cells(read), "v", GABORS, "reflect", "r"), "r")


@query("F2_matched_bank", bank_sql(LINES))
def _(read):
    return pick(T.filter_bank_max(cells(read), "v", LINES, "reflect", "r"), "r")


GABOR_FULL = T.gabor_bank()
MATCHED_FULL = T.matched_bank(T.MATCHED_FINE)
DOGS = [K.difference(K.gaussian(s), K.gaussian(s * 1.4)) for s in (0.5, 0.8)]


@query("F2_gabor_bank_full", bank_sql(GABOR_FULL))
def _(read):
    return pick(T.filter_bank_max(cells(read), "v", GABOR_FULL, "reflect", "r"), "r")


@query("F2_matched_bank_fine", bank_sql(MATCHED_FULL))
def _(read):
    return pick(T.filter_bank_max(cells(read), "v", MATCHED_FULL, "reflect", "r"), "r")


@query("F2_dog_response", bank_sql(DOGS))
def _(read):
    return pick(T.dog_response(cells(read), "v", (0.5, 0.8), 1.4, "reflect", "r"), "r")


ELL = [(y, x) for y, x in K.ellipse(5)]


@query(
    "F3_erode_dilate",
    f"WITH {CELLS} " + window_sql("cells", ELL, "constant", "min(n.v) AS lo, max(n.v) AS hi"),
)
def _(read):
    specs = {"lo": ("v", ELL, "min"), "hi": ("v", ELL, "max")}
    return R.extremes(cells(read), specs).select("image_id", "y", "x", "lo", "hi")


def _twice(name, table, element, first, second, col):
    return (
        f"{name}1 AS ({window_sql(table, element, 'constant', f'{first}(n.{col}) AS m')}), "
        f"{name} AS ({window_sql(f'{name}1', element, 'constant', f'{second}(n.m) AS m')})"
    )


LINE3 = K.line_element(3, 45)


@query(
    "F3_open_close",
    f"""WITH {MASKED}, {_twice('cl', 'masked', K.ellipse(3), 'max', 'min', 'pred')}, {_twice('op', 'masked', LINE3, 'min', 'max', 'pred')}
SELECT image_id, y, x, cl.m AS closed, op.m AS opened FROM cl JOIN op USING (image_id, y, x)""",
)
def _(read):
    closed = R.closing(masked_cells(read), "pred", K.ellipse(3), "closed")
    return R.opening(closed, "pred", LINE3, "opened").select("image_id", "y", "x", "closed", "opened")


@query(
    "F4_tophat",
    f"""WITH {U8}, {_twice('a', 'u8', K.ellipse(3), 'min', 'max', 'v8')}, {_twice('b', 'u8', K.ellipse(5), 'min', 'max', 'v8')}
SELECT image_id, y, x, greatest(v8 - a.m, v8 - b.m, 0.0) AS th FROM u8 JOIN a USING (image_id, y, x) JOIN b USING (image_id, y, x)""",
)
def _(read):
    return pick(R.tophat(u8_cells(read), "v8", [K.ellipse(3), K.ellipse(5)], "th"), "th")


@query(
    "F4_blackhat",
    f"""WITH {U8}, {_twice('a', 'u8', K.ellipse(5), 'max', 'min', 'v8')}
SELECT image_id, y, x, greatest(a.m - v8, 0.0) AS bh FROM u8 JOIN a USING (image_id, y, x)""",
)
def _(read):
    return pick(R.blackhat(u8_cells(read), "v8", [K.ellipse(5)], "bh"), "bh")


ORIENTED = [K.line_element(5, a) for a in (0, 45, 90, 135)]


@query(
    "F4_oriented_tophat",
    f"""WITH {U8}, {', '.join(_twice(f'o{i}', 'u8', el, 'min', 'max', 'v8') for i, el in enumerate(ORIENTED))}
SELECT image_id, y, x, greatest({', '.join(f'v8 - o{i}.m' for i in range(4))}, 0.0) AS th FROM u8
{' '.join(f'JOIN o{i} USING (image_id, y, x)' for i in range(4))}""",
)
def _(read):
    return pick(R.tophat(u8_cells(read), "v8", ORIENTED, "th"), "th")


@query(
    "F5_focal_median",
    f"WITH {CELLS} " + window_sql("cells", [(a, b) for a, b in K.square(3)], "replicate", "median(n.v) AS m"),
)
def _(read):
    return T.focal_median(cells(read), "v", 3, "m").select("image_id", "y", "x", "m")


@query(
    "F6_local_z",
    f"""WITH {U8}, m3 AS ({window_sql('u8', K.square(3), 'reflect', 'avg(n.v8) AS m, avg(n.v8 * n.v8) AS q')}),
m5 AS ({window_sql('u8', K.square(5), 'reflect', 'avg(n.v8) AS m, avg(n.v8 * n.v8) AS q')})
SELECT image_id, y, x, round(CASE WHEN fov THEN greatest(
  least(greatest(greatest(m3.m - v8, 0) / greatest(sqrt(greatest(m3.q - m3.m * m3.m, 0)), 2.5) / 2.5, 0.0), 1.0),
  least(greatest(greatest(m5.m - v8, 0) / greatest(sqrt(greatest(m5.q - m5.m * m5.m, 0)), 3.0) / 3.0, 0.0), 1.0)) ELSE 0.0 END, 6) AS z
FROM u8 JOIN m3 USING (image_id, y, x) JOIN m5 USING (image_id, y, x)""",
)
def _(read):
    return pick(T.local_z(u8_cells(read), "v8", "fov", [(3, 2.5, 2.5), (5, 3.0, 3.0)], "z"), "z")


@query(
    "F6_local_std",
    f"""WITH {U8}, m AS ({window_sql('u8', K.square(3), 'reflect', 'avg(n.v8) AS m, avg(n.v8 * n.v8) AS q')})
SELECT image_id, y, x, round(sqrt(greatest(q - m * m, 0)), 5) AS sd FROM m""",
)
def _(read):
    return pick(T.local_std(u8_cells(read), "v8", 3, "sd"), "sd", digits=5)


@query(
    "F6_noise_maps",
    f"""WITH {U8}, g AS ({window_sql('u8', taps_of(K.gaussian(0.8)), 'reflect', 'sum(n.v8 * k.w0) AS g')}),
md AS ({window_sql('u8', K.square(3), 'replicate', 'median(n.v8) AS m')})
SELECT image_id, y, x, round(abs(v8 - g), 6) AS high_frequency, round(abs(v8 - m), 6) AS residual FROM u8 JOIN g USING (image_id, y, x) JOIN md USING (image_id, y, x)""",
)
def _(read):
    return pick(T.noise_maps(u8_cells(read), "v8", 0.8, 3), "high_frequency", "residual")


BILATERAL = [(a, b, math.exp(-(a * a + b * b) / 8.0)) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
_W = "k.w0 * exp(-pow(n.v8 - c.v8, 2) / 3200.0)"


@query(
    "F7_bilateral",
    f"WITH {U8} " + window_sql("u8", BILATERAL, "reflect101", f"round(sum({_W} * n.v8) / sum({_W}), 6) AS b"),
)
def _(read):
    return pick(T.bilateral(u8_cells(read), "v8", 5, 40.0, 2.0, "b"), "b")


@query(
    "F8_coherence",
    f"""WITH {U8}, g AS ({window_sql('u8', taps_of(K.sobel('x'), K.sobel('y')), 'reflect101', 'sum(n.v8 * k.w0) AS gx, sum(n.v8 * k.w1) AS gy')}),
j AS ({window_sql('g', taps_of(K.gaussian(1.0, radius=2)), 'reflect101', 'sum(k.w0 * n.gx * n.gx) AS xx, sum(k.w0 * n.gy * n.gy) AS yy, sum(k.w0 * n.gx * n.gy) AS xy')})
SELECT image_id, y, x, round(least(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy + 1e-6), 1.0), 6) AS coh FROM j""",
)
def _(read):
    return pick(T.coherence(u8_cells(read), "v8", 1.0, "coh", radius=2), "coh")


SIGMAS = (0.7, 1.0)
_HK = [K.gaussian_derivative(s, a, b, 2) for s in SIGMAS for a, b in ((2, 0), (1, 1), (0, 2))]
HESS = f"""hs AS ({window_sql('cells', taps_of(*_HK), 'reflect', ', '.join(f'sum(n.v * k.w{i}) AS d{i}' for i in range(6)) + ', any_value(c.fov) AS fov')}),
eg AS (SELECT *, {', '.join(f'(d{3*i}+d{3*i+2})/2 + sqrt(pow((d{3*i}-d{3*i+2})/2, 2) + d{3*i+1}*d{3*i+1}) AS hi{i}, -((d{3*i}+d{3*i+2})/2 - sqrt(pow((d{3*i}-d{3*i+2})/2, 2) + d{3*i+1}*d{3*i+1})) AS s{i}' for i in range(2))} FROM hs)"""


@query(
    "F9_hessian_jerman",
    f"""WITH {CELLS}, {HESS}, top AS (SELECT image_id, {', '.join(f'quantile_cont(s{i}, 0.99) FILTER (s{i} > 0) AS t{i}' for i in range(2))} FROM eg WHERE fov GROUP BY image_id),
r AS (SELECT image_id, y, x, fov, CASE WHEN fov THEN greatest(0.0, {', '.join(f'CASE WHEN s{i} > 0 AND t{i} > 0 THEN least(s{i} / t{i}, 1.0) * exp(-(hi{i} * hi{i}) / (2 * (s{i} * s{i} + 1e-6))) ELSE 0.0 END' for i in range(2))}) ELSE 0.0 END AS v FROM eg JOIN top USING (image_id)),
e AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, min(v) AS mn, max(v) AS mx FROM r WHERE fov GROUP BY image_id)
SELECT image_id, y, x, round(CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0.0), 1.0) WHEN mx > mn THEN least(greatest((v - mn) / (mx - mn), 0.0), 1.0) ELSE 0.0 END, 6) AS j
FROM r JOIN e USING (image_id)""",
)
def _(read):
    return pick(T.hessian_response(cells(read), "v", SIGMAS, "jerman", "fov", "j", radius=2), "j")


def _hessian_sql(method):
    """Per-scale response from eigenvalues: hi is the larger, -s the smaller one."""
    tops, scores = [], []
    for i, sigma in enumerate(SIGMAS):
        s, hi, t, q = f"s{i}", f"hi{i}", f"t{i}", repr(sigma * sigma)
        x, y = f"({hi} - {s} / 3)", f"({hi} / 3 - {s})"
        neurite = f"greatest(-(CASE WHEN abs({x}) > abs({y}) THEN {x} ELSE {y} END), 0.0)"
        blob = f"exp(-({hi} * {hi}) / (2 * ({s} * {s} + 1e-6)))"
        rho = f"least(greatest({s} / (0.9 * {t}), 0.0), 1.0)"
        l1 = f"(CASE WHEN abs({s}) >= abs({hi}) THEN {hi} ELSE -{s} END * {q})"
        l2 = f"(CASE WHEN abs({s}) >= abs({hi}) THEN -{s} ELSE {hi} END * {q})"
        tops.append(
            {
                "jerman_smooth": f"quantile_cont({s}, 0.995) FILTER (fov AND {s} > 0)",
                "frangi": f"max(sqrt({hi} * {hi} + {s} * {s}) * {q}) / 2",
                "sato": "max(0)",
                "meijering": f"max({neurite})",
            }[method]
            + f" AS {t}"
        )
        scores.append(
            {
                "jerman_smooth": f"CASE WHEN {s} > 0 AND {t} > 0 THEN {rho} * {rho} * (3 - 2 * {rho}) * {blob} ELSE 0.0 END",
                "frangi": f"CASE WHEN {l2} < 0 AND {t} > 0 THEN exp(-pow({l1} / {l2}, 2) / 0.5) * (1 - exp(-({l1} * {l1} + {l2} * {l2}) / (2 * {t} * {t}))) ELSE 0.0 END",
                "sato": f"greatest({s}, 0.0) * {q}",
                "meijering": f"CASE WHEN {t} > 0 THEN {neurite} / {t} ELSE 0.0 END",
            }[method]
        )
    return f"""WITH {CELLS}, {HESS}, top AS (SELECT image_id, {', '.join(tops)} FROM eg GROUP BY image_id),
r AS (SELECT image_id, y, x, fov, CASE WHEN fov THEN greatest(0.0, {', '.join(scores)}) ELSE 0.0 END AS v FROM eg JOIN top USING (image_id)),
e AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, min(v) AS mn, max(v) AS mx FROM r WHERE fov GROUP BY image_id)
SELECT image_id, y, x, round(CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0.0), 1.0) WHEN mx > mn THEN least(greatest((v - mn) / (mx - mn), 0.0), 1.0) ELSE 0.0 END, 6) AS r
FROM r JOIN e USING (image_id)"""


for _method in ("jerman_smooth", "frangi", "sato", "meijering"):

    @query(f"F9_hessian_{_method}", _hessian_sql(_method))
    def _(read, method=_method):
        return pick(T.hessian_response(cells(read), "v", SIGMAS, method, "fov", "r", radius=2), "r")


@query(
    "F10_clahe",
    f"""WITH {U8}, tl AS (SELECT image_id, y, x, CAST(v8 AS INTEGER) AS bin, y // 4 AS ty, x // 4 AS tx FROM u8),
hist AS (SELECT image_id, ty, tx, bin, count(*) AS c FROM tl GROUP BY ALL),
lim AS (SELECT image_id, ty, tx, sum(greatest(c - 1, 0)) AS over FROM hist GROUP BY ALL),
ask AS (SELECT tl.image_id, tl.y, tl.x, tl.bin, least(greatest(CAST(floor(y / 4.0 - 0.5) AS INTEGER) + a, 0), 1) AS ty,
  least(greatest(CAST(floor(x / 4.0 - 0.5) AS INTEGER) + b, 0), 1) AS tx,
  (CASE WHEN a = 1 THEN y / 4.0 - 0.5 - floor(y / 4.0 - 0.5) ELSE 1 - (y / 4.0 - 0.5 - floor(y / 4.0 - 0.5)) END)
  * (CASE WHEN b = 1 THEN x / 4.0 - 0.5 - floor(x / 4.0 - 0.5) ELSE 1 - (x / 4.0 - 0.5 - floor(x / 4.0 - 0.5)) END) AS f
  FROM tl, (SELECT unnest(range(2)) AS a) p, (SELECT unnest(range(2)) AS b) q),
lut AS (SELECT k.image_id, k.ty, k.tx, k.bin, least(round_even((sum(CASE WHEN h.bin <= k.bin THEN least(h.c, 1) ELSE 0 END)
    + (l.over // 256) * (k.bin + 1) + least(l.over % 256, k.bin // greatest(256 // greatest(l.over % 256, 1), 1) + 1)) * (255.0 / 16), 0), 255.0) AS lut
  FROM (SELECT DISTINCT image_id, ty, tx, bin FROM ask) k JOIN hist h USING (image_id, ty, tx) JOIN lim l USING (image_id, ty, tx)
  GROUP BY k.image_id, k.ty, k.tx, k.bin, l.over)
SELECT image_id, y, x, round_even(round(sum(f * lut), 6), 0) AS eq FROM ask JOIN lut USING (image_id, ty, tx, bin) GROUP BY image_id, y, x""",
)
def _(read):
    return pick(Q.clahe(u8_cells(read), "v8", 2.0, (2, 2), "eq"), "eq")


@query(
    "F12_edge_distance",
    f"""WITH {MASKED}, d AS (SELECT c.image_id, c.y, c.x, min(pow(c.y - n.y, 2) + pow(c.x - n.x, 2)) AS d2 FROM masked c
  LEFT JOIN masked n ON n.image_id = c.image_id AND NOT n.fov GROUP BY ALL)
SELECT image_id, y, x, round(sqrt(d2), 6) AS distance, d2 <= 4 AND fov AS band,
  round(CASE WHEN fov THEN least(greatest((sqrt(d2) - 1.0) / 2.0, 0.0), 1.0) ELSE 0.0 END, 6) AS weight
FROM d JOIN masked USING (image_id, y, x)""",
)
def _(read):
    from cellgrove.operators import borders as B

    df = edge_distance(masked_cells(read), "fov", "distance")
    df = df.withColumns({"band": B.border_band("distance", "fov", 2.0), "weight": B.edge_weight("distance", "fov", 1.0, 2.0)})
    return pick(df, "distance", "band", "weight")


TRIED = [(3, 0.55), (2, 0.42), (1, None)]


@query(
    "F12_shrink_mask",
    f"""WITH {MASKED}, d AS (SELECT c.image_id, c.y, c.x, c.fov, coalesce(min(pow(c.y - n.y, 2) + pow(c.x - n.x, 2)), 1e9) AS d2 FROM masked c
  LEFT JOIN masked n ON n.image_id = c.image_id AND NOT n.fov GROUP BY ALL),
n AS (SELECT image_id, count(*) FILTER (fov) AS a, {', '.join(f'count(*) FILTER (fov AND d2 > {r * r}) AS n{r}' for r, _ in TRIED)} FROM d GROUP BY image_id)
SELECT image_id, y, x, fov AND d2 > CASE WHEN n3 >= floor(a * 0.55) THEN 9 WHEN n2 >= floor(a * 0.42) THEN 4 WHEN n1 >= 1 THEN 1 ELSE -1 END AS inner
FROM d JOIN n USING (image_id)""",
)
def _(read):
    from cellgrove.operators.borders import shrink_mask

    return pick(shrink_mask(masked_cells(read), "fov", "inner", [(F.lit(r), share) for r, share in TRIED]), "inner")


OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, 3), (2, 2), (3, 0), (2, -2)]


@query(
    "F13_glcm",
    f"""WITH {U8}, q AS (SELECT image_id, y, x, CAST(CASE WHEN fov THEN least(floor(v8 / 256.0 * 32), 31) ELSE 0 END AS INTEGER) AS l FROM u8),
o AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(OFFSETS))}) t(k, dy, dx)),
one AS (SELECT a.image_id, k, a.l AS i, b.l AS j FROM q a CROSS JOIN o JOIN q b ON b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx),
two AS (SELECT * FROM one UNION ALL SELECT image_id, k, j, i FROM one),
cnt AS (SELECT image_id, k, i, j, count(*) AS n FROM two GROUP BY ALL),
p AS (SELECT image_id, k, i, j, n / sum(n) OVER (PARTITION BY image_id, k) AS p FROM cnt),
f AS (SELECT image_id, k, sum(p * pow(i - j, 2)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + pow(i - j, 2))) AS homogeneity,
  sqrt(sum(p * p)) AS energy, sum(p * p) AS asm, (sum(p * i * j) - pow(sum(p * i), 2)) / (sum(p * i * i) - pow(sum(p * i), 2)) AS correlation FROM p GROUP BY ALL)
SELECT image_id, {', '.join(f'round(avg({c}), 6) + 0.0 AS glcm_{n}_mean, round(stddev_pop({c}), 5) + 0.0 AS glcm_{n}_std' for n, c in (('contrast', 'contrast'), ('dissimilarity', 'dissimilarity'), ('homogeneity', 'homogeneity'), ('energy', 'energy'), ('correlation', 'correlation'), ('ASM', 'asm')))}
FROM f GROUP BY image_id""",
)
def _(read):
    out = Q.glcm(u8_cells(read), "v8", "fov", distances=(1, 3))
    return out.select(
        "image_id",
        *[F.round(c, 6 if c.endswith("mean") else 5).alias(c) for c in out.columns if c != "image_id"],
    )
