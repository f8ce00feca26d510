"""Masked per-image statistics (section D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CELLS, MASKED, U8, cells, masked_cells, pick, rounded, u8_cells
from cellgrove.operators import masked as M
from cellgrove.operators.distance import fill_nearest

CLIP = "least(greatest((v - lo) / (hi - lo), 0.0), 1.0)"
EDGES = """e AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, min(v) AS mn, max(v) AS mx
  FROM cells WHERE fov GROUP BY image_id)"""
FALLBACK = f"CASE WHEN hi > lo THEN {CLIP} WHEN mx > mn THEN least(greatest((v - mn) / (mx - mn), 0.0), 1.0) ELSE 0.0 END"


@query("D1_normalise_fallback", f"WITH {CELLS}, {EDGES} SELECT image_id, y, x, round({FALLBACK}, 6) AS n FROM cells JOIN e USING (image_id)")
def _(read):
    return pick(M.normalise(cells(read), "v", "fov", "n"), "n")


@query(
    "D1_normalise_floor",
    f"WITH {CELLS}, {EDGES} SELECT image_id, y, x, round(least(greatest((v - lo) / greatest(hi - lo, 1e-8), 0.0), 1.0), 6) AS n FROM cells JOIN e USING (image_id)",
)
def _(read):
    return pick(M.normalise(cells(read), "v", "fov", "n", "floor"), "n")


@query(
    "D1_normalise_masked",
    f"WITH {CELLS}, {EDGES} SELECT image_id, y, x, round(CASE WHEN fov THEN {FALLBACK} ELSE 0.0 END, 6) AS n FROM cells JOIN e USING (image_id)",
)
def _(read):
    return pick(M.normalise(cells(read), "v", "fov", "n", "masked"), "n")


@query(
    "D2_stretch_u8",
    f"""WITH {CELLS}, e AS (SELECT image_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM cells WHERE fov GROUP BY image_id)
SELECT image_id, y, x, CASE WHEN fov THEN round_even({CLIP} * 255.0, 0) ELSE 0.0 END AS s FROM cells JOIN e USING (image_id)""",
)
def _(read):
    return pick(M.stretch_u8(cells(read), "v", "fov", "s"), "s")


@query(
    "D2_percentile_floor",
    f"""WITH {CELLS}, e AS (SELECT image_id, quantile_cont(v, 0.45) AS lo, quantile_cont(v, 0.992) AS hi FROM cells WHERE fov GROUP BY image_id)
SELECT image_id, y, x, round(CASE WHEN fov THEN pow({CLIP}, 0.95) ELSE 0.0 END, 6) AS f FROM cells JOIN e USING (image_id)""",
)
def _(read):
    return pick(M.percentile_floor(cells(read), "v", "fov", "f", 0.45, 0.992, 0.95), "f")


@query(
    "D3_fill_median",
    f"""WITH {CELLS}, e AS (SELECT image_id, median(v) AS med FROM cells WHERE fov GROUP BY image_id)
SELECT image_id, y, x, round(CASE WHEN fov THEN v ELSE med END, 6) + 0.0 AS filled FROM cells JOIN e USING (image_id)""",
)
def _(read):
    return pick(M.fill_median(cells(read), "v", "fov", "filled"), "filled")


@query(
    "D4_fill_nearest",
    f"""WITH {MASKED}, near AS (SELECT c.image_id, c.y, c.x,
  arg_min(n.v, ((c.y - n.y) * (c.y - n.y) + (c.x - n.x) * (c.x - n.x)) * 10000 + n.y * 100 + n.x) AS nv
  FROM masked c JOIN masked n ON n.image_id = c.image_id AND n.pred WHERE NOT c.pred GROUP BY ALL)
SELECT m.image_id, m.y, m.x, CASE WHEN pred THEN v ELSE coalesce(nv, v) END AS filled FROM masked m LEFT JOIN near USING (image_id, y, x)""",
)
def _(read):
    return fill_nearest(masked_cells(read), "v", "pred", "filled").select("image_id", "y", "x", "filled")


ACTIVE = """f AS (SELECT image_id, greatest(0.02, quantile_cont(n, 0.35)) AS fl FROM u8 WHERE fov GROUP BY image_id),
act AS (SELECT image_id, {cols} FROM u8 JOIN f USING (image_id) WHERE fov GROUP BY image_id)"""


def _active(p):
    return f"coalesce(quantile_cont(n, {p}) FILTER (n > fl), quantile_cont(n, {p}), 1.0)"


@query(
    "D5_active_percentile",
    f"WITH {U8}, {ACTIVE.format(cols=f'round({_active(0.78)}, 6) AS p78, round({_active(0.45)}, 6) AS p45')} SELECT * FROM act",
)
def _(read):
    return rounded(M.active_percentiles(u8_cells(read), {"p78": ("n", 0.78), "p45": ("n", 0.45)}, "fov"))


@query(
    "D6_response_features",
    f"""WITH {CELLS}, m AS (SELECT image_id, avg(v) AS m1, stddev_pop(v) AS sd FROM cells WHERE fov GROUP BY image_id)
SELECT image_id, round(m1, 6) + 0.0 AS soft_mean, round(sd, 6) AS soft_std, round(quantile_cont(v, 0.90), 6) + 0.0 AS soft_p90,
  round(quantile_cont(v, 0.95), 6) + 0.0 AS soft_p95, round(quantile_cont(v, 0.99), 6) + 0.0 AS soft_p99,
  round(avg(pow(v - m1, 3)) / (pow(sd, 3) + 1e-6), 6) + 0.0 AS soft_skew
FROM cells JOIN m USING (image_id) WHERE fov GROUP BY image_id, m1, sd""",
)
def _(read):
    return rounded(M.response_features(cells(read), "v", "fov", "soft"))


@query(
    "D7_intensity_features",
    """SELECT l_returnflag, round(avg(l_quantity), 6) AS int_l_quantity_mean, round(avg(l_discount), 6) AS int_l_discount_mean,
  round(stddev_pop(l_quantity), 6) AS int_l_quantity_std, round(stddev_pop(l_discount), 6) AS int_l_discount_std
FROM lineitem GROUP BY l_returnflag""",
)
def _(read):
    return rounded(M.intensity_features(read("lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"]))


@query(
    "D8_coverage_stats",
    f"""WITH {U8}, s AS (SELECT image_id, avg(CAST(n > 0.5 AS DOUBLE)) AS share FROM u8 GROUP BY image_id)
SELECT round(min(share), 6) AS min_share, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share,
  count(*) FILTER (share > 0.98) AS n_full, count(*) FILTER (share < 0.2) AS n_sparse FROM s""",
)
def _(read):
    return rounded(M.coverage_stats(u8_cells(read).withColumn("m", F.col("n") > 0.5), "m"))


SIGNALS = """sig AS (SELECT *, (n + 1.0 - n * n) / 2 AS s, abs(n - 0.5) * 2 AS c FROM u8)"""
NOISE = f"""{SIGNALS},
fl AS (SELECT image_id, greatest(0.02, quantile_cont(n, 0.35)) AS fn, greatest(0.02, quantile_cont(s, 0.35)) AS fs,
  greatest(0.05, quantile_cont(c, 0.45)) AS cc FROM sig WHERE fov GROUP BY image_id),
cut AS (SELECT image_id, cc, coalesce(quantile_cont(n, 0.65) FILTER (n > fn), quantile_cont(n, 0.65)) AS cr,
  coalesce(quantile_cont(s, 0.48) FILTER (s > fs), quantile_cont(s, 0.48)) AS cs FROM sig JOIN fl USING (image_id) WHERE fov GROUP BY image_id, cc),
noise AS (SELECT image_id, avg(CAST(n >= cr AND (s < cs OR c < cc) AS DOUBLE)) AS noise FROM sig JOIN cut USING (image_id) WHERE fov GROUP BY image_id)"""


def signals(read):
    n = F.col("n")
    return u8_cells(read).withColumns({"s": (n + 1.0 - n * n) / 2, "c": F.abs(n - 0.5) * 2})


@query(
    "D9_noise_score",
    f"WITH {U8}, {NOISE} SELECT image_id, round(noise, 6) AS noise, round(least(greatest((noise - 0.10) / 0.18, 0.0), 1.0), 6) AS strength FROM noise",
)
def _(read):
    return rounded(M.noise_score(signals(read), "n", "s", "c", "fov"))


@query(
    "D10_agreement",
    f"""WITH {U8}, {SIGNALS} SELECT image_id, y, x, round((CAST(n >= 0.7 AS INTEGER) + CAST(s >= 0.5 AS INTEGER) + CAST(c >= 0.4 AS INTEGER)) / 3.0, 6) AS agreement FROM sig""",
)
def _(read):
    tests = [F.col("n") >= 0.7, F.col("s") >= 0.5, F.col("c") >= 0.4]
    return pick(M.agreement(signals(read), tests, "agreement"), "agreement")
