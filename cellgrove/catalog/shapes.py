"""Component and shape queries (section E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import LABELS, MASKED, U8, cells, masked_cells, pick, rounded, u8_cells, window_sql
from cellgrove.functions.kernels import ellipse
from cellgrove.operators import components as P
from cellgrove.operators import shapes as S
from cellgrove.operators import skeleton as K

WITH = f"WITH {MASKED}, {LABELS}"
STATS = f"""{WITH}, lab AS (SELECT m.*, l.comp FROM masked m LEFT JOIN labels8 l ON l.image_id = m.image_id AND l.pos = m.y * 8 + m.x),
st AS (SELECT image_id, comp, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh,
  avg(x) AS cx, avg(y) AS cy, coalesce(var_samp(x), 0.0) AS vx, coalesce(var_samp(y), 0.0) AS vy, coalesce(covar_samp(x, y), 0.0) AS cxy,
  avg(v) AS mean_v, max(v) AS max_v FROM lab WHERE comp IS NOT NULL GROUP BY ALL),
eg AS (SELECT *, (vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + cxy * cxy) AS emax, (vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + cxy * cxy) AS emin,
  CAST(area AS DOUBLE) / (bw * bh) AS extent, CAST(greatest(bw, bh) AS DOUBLE) / greatest(least(bw, bh), 1) AS aspect FROM st)"""
KEPT = "SELECT image_id, y, x, coalesce(g.ok, false) AS kept FROM lab LEFT JOIN (SELECT image_id, comp, true AS ok FROM {src} WHERE {rule}) g USING (image_id, comp)"


def labelled(read):
    return P.label(masked_cells(read), "pred")


@query("E1_components_8", f"{WITH} SELECT image_id, CAST(pos AS BIGINT) AS pos, CAST(comp AS BIGINT) AS comp FROM labels8")
def _(read):
    lab = labelled(read).filter("comp is not null")
    return lab.select("image_id", (F.col("y").cast("long") * 8 + F.col("x")).alias("pos"), "comp")


@query(
    "E1_components_4",
    f"{WITH.replace('AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1', 'AND abs(a.y - b.y) + abs(a.x - b.x) <= 1')} SELECT image_id, CAST(pos AS BIGINT) AS pos, CAST(comp AS BIGINT) AS comp FROM labels8",
)
def _(read):
    lab = P.label(masked_cells(read), "pred", conn=4).filter("comp is not null")
    return lab.select("image_id", (F.col("y").cast("long") * 8 + F.col("x")).alias("pos"), "comp")


@query(
    "E2_component_stats",
    f"""{STATS} SELECT image_id, CAST(comp AS BIGINT) AS comp, area, x0, y0, bw, bh, round(cx, 6) AS cx, round(cy, 6) AS cy, round(emax, 6) AS eig_max,
  round(emin, 6) + 0.0 AS eig_min, round(extent, 6) AS extent, round(aspect, 6) AS aspect, round(mean_v, 6) AS mean_v, round(max_v, 6) AS max_v,
  round(CASE WHEN area < 3 THEN 1.0 ELSE sqrt(greatest(emax, greatest(abs(emin), 1e-3)) / greatest(abs(emin), 1e-3)) END, 5) AS ratio_floor,
  round(CASE WHEN area < 3 THEN 1.0 ELSE sqrt((emax + 1e-6) / (abs(round(emin, 12)) + 1e-6)) END, 2) AS ratio_epsilon,
  round(4 * sqrt(greatest(emax, 0)), 5) AS major FROM eg""",
)
def _(read):
    stats = P.component_stats(labelled(read), values=("v",))
    stats = stats.withColumn("eig_min", F.round("eig_min", 12)).withColumns(
        {
            "ratio_floor": F.round(P.axis_ratio("floor"), 5),
            "ratio_epsilon": F.round(P.axis_ratio("epsilon"), 2),
            "major": F.round(P.major_axis(), 5),
        }
    )
    return rounded(stats.drop("h", "w", "var_x", "var_y", "cov_xy"))


@query("E3_min_area", f"{STATS} {KEPT.format(src='eg', rule='area >= 3')}")
def _(read):
    return pick(P.min_area(labelled(read), 3, "kept"), "kept")


@query(
    "E4_top_k",
    f"""{STATS}, rk AS (SELECT image_id, comp, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp DESC) AS r FROM eg)
{KEPT.format(src='rk', rule='r <= 2')}""",
)
def _(read):
    return pick(P.top_k(labelled(read), 2, "kept"), "kept")


@query("E5_drop_border", f"{STATS} {KEPT.format(src='eg', rule='x0 >= 1 AND y0 >= 1 AND x0 + bw <= 7 AND y0 + bh <= 7')}")
def _(read):
    return pick(P.drop_border(labelled(read), 1, "kept"), "kept")


@query(
    "E6_drop_edge_lines",
    f"{STATS} {KEPT.format(src='eg', rule='NOT ((x0 <= 1 OR y0 <= 1 OR x0 + bw >= 7 OR y0 + bh >= 7) AND aspect >= 3.0 AND extent >= 0.12)')}",
)
def _(read):
    return pick(P.drop_edge_lines(labelled(read), 1, "kept", aspect=3.0), "kept")


@query("E7_keep_elongated", f"{STATS} {KEPT.format(src='eg', rule='aspect >= 2.0 AND area >= 2')}")
def _(read):
    return pick(P.keep_elongated(labelled(read), 2.0, 2, "kept"), "kept")


@query(
    "E7_vessel_like",
    f"{STATS} {KEPT.format(src='eg', rule='area >= 6 OR (area >= 3 AND sqrt((emax + 1e-6) / (abs(emin) + 1e-6)) >= 1.6 AND 4 * sqrt(greatest(emax, 0)) >= 3)')}",
)
def _(read):
    lab = labelled(read)
    return pick(P.keep(lab, P.component_stats(lab), P.vessel_like(6, 3, 1.6), "kept"), "kept")


@query("E7_shape_clean")
def _(read):
    lab = P.label(K.thin(masked_cells(read), "pred", "skel"), "pred")
    stats = P.component_stats(lab, counts=("skel",))
    return pick(P.keep(lab, stats, P.shape_rule(6, 3, 1.6, 2), "kept"), "kept")


SIG = """sig AS (SELECT image_id, y, x, fov, n, (n + 1.0 - n * n) / 2 AS s, abs(n - 0.5) * 2 AS c FROM u8)"""


def signals(read):
    n = F.col("n")
    return u8_cells(read).withColumns({"s": (n + 1.0 - n * n) / 2, "c": F.abs(n - 0.5) * 2})


@query(
    "E8_suppress_blobs",
    f"""WITH RECURSIVE {U8}, {SIG}, fl AS (SELECT image_id, greatest(0.02, quantile_cont(n, 0.35)) AS fn, greatest(0.02, quantile_cont(s, 0.35)) AS fs,
  greatest(0.05, quantile_cont(c, 0.40)) AS cf FROM sig WHERE fov GROUP BY image_id),
ct AS (SELECT image_id, cf, coalesce(quantile_cont(n, 0.78) FILTER (n > fn), quantile_cont(n, 0.78)) AS cr,
  coalesce(quantile_cont(s, 0.45) FILTER (s > fs), quantile_cont(s, 0.45)) AS sf FROM sig JOIN fl USING (image_id) WHERE fov GROUP BY image_id, cf),
m AS (SELECT image_id, y, x, y * 8 + x AS pos, s, c, sf, cf FROM sig JOIN ct USING (image_id) WHERE fov AND n >= cr),
reach AS (SELECT image_id, pos, pos AS comp FROM m UNION SELECT b.image_id, b.pos, r.comp FROM reach r JOIN m a ON a.image_id = r.image_id AND a.pos = r.pos
  JOIN m b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE r.comp < b.pos),
lb AS (SELECT image_id, pos, min(comp) AS comp FROM reach GROUP BY ALL),
st AS (SELECT image_id, comp, count(*) AS area, avg(s) AS ms, avg(c) AS mc, any_value(sf) AS sf, any_value(cf) AS cf, coalesce(var_samp(x), 0) AS vx,
  coalesce(var_samp(y), 0) AS vy, coalesce(covar_samp(x, y), 0) AS cxy FROM m JOIN lb USING (image_id, pos) GROUP BY image_id, comp),
blob AS (SELECT image_id, comp FROM (SELECT *, (vx + vy) / 2 AS hf, sqrt(pow((vx - vy) / 2, 2) + cxy * cxy) AS rt FROM st)
  WHERE area >= 4 AND (CASE WHEN area < 3 THEN 1.0 ELSE sqrt((hf + rt + 1e-6) / (abs(hf - rt) + 1e-6)) END < 1.9 OR (area >= 6 AND (ms < sf OR mc < cf))))
SELECT g.image_id, g.y, g.x, round(CASE WHEN NOT fov THEN 0.0 WHEN b.comp IS NOT NULL THEN n * 0.45 ELSE n END, 6) AS damped
FROM sig g LEFT JOIN lb ON lb.image_id = g.image_id AND lb.pos = g.y * 8 + g.x LEFT JOIN blob b ON b.image_id = lb.image_id AND b.comp = lb.comp""",
)
def _(read):
    out = S.suppress_blobs(signals(read), "n", "s", "c", "fov", "damped", area=4, big=6)
    return pick(out, "damped")


@query("E9_recover_components")
def _(read):
    out = S.recover_components(masked_cells(read), "pred", "v", "fov", "kept", ratio=1.5, length=2, branch_density=0.5, area=3)
    return pick(out, "kept")


@query("E10_clean_noise")
def _(read):
    df = signals(read).withColumn("m", F.col("fov") & (F.col("n") > 0.7))
    return pick(S.clean_noise(df, "m", "n", "s", "c", "fov", "kept", large=6, near=2, like=(5, 3, 1.6)), "kept")


@query("E10_near_tree")
def _(read):
    df = signals(read).withColumn("seed", F.col("fov") & (F.col("n") > 0.9))
    return pick(S.near_tree(df, "seed", "n", "s", "c", "fov", "kept", radius=2), "kept")


def _close(name, src, col, first):
    return f"{name} AS ({window_sql(src, ellipse(3), 'constant', f'{first}(n.{col}) AS m')})"


@query(
    "E11_fov_mask",
    f"""WITH RECURSIVE {U8}, gr AS (SELECT image_id, y, x, greatest(v8 - 60.0, 0.0) AS g FROM u8),
p AS (SELECT image_id, greatest(3.0, floor(quantile_cont(g, 0.01))) AS t FROM gr GROUP BY image_id),
l2 AS (SELECT image_id, y, x, g > t AS m FROM gr JOIN p USING (image_id)),
{_close('c1', 'l2', 'm', 'max')}, {_close('c2', 'c1', 'm', 'max')}, {_close('c3', 'c2', 'm', 'min')}, {_close('c4', 'c3', 'm', 'min')},
bg AS (SELECT image_id, y, x FROM c4 WHERE NOT m),
outer_bg AS (SELECT image_id, y, x FROM bg WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT b.image_id, b.y, b.x FROM outer_bg o JOIN bg b
  ON b.image_id = o.image_id AND abs(b.y - o.y) + abs(b.x - o.x) = 1),
full_m AS (SELECT c4.image_id, c4.y, c4.x, c4.y * 8 + c4.x AS pos FROM c4 LEFT JOIN outer_bg o USING (image_id, y, x) WHERE o.image_id IS NULL),
reach AS (SELECT image_id, pos, pos AS comp FROM full_m UNION SELECT b.image_id, b.pos, r.comp FROM reach r JOIN full_m a ON a.image_id = r.image_id AND a.pos = r.pos
  JOIN full_m b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE r.comp < b.pos),
lb AS (SELECT image_id, pos, min(comp) AS comp FROM reach GROUP BY ALL),
sz AS (SELECT image_id, comp, count(*) AS n FROM lb GROUP BY ALL),
big AS (SELECT image_id, comp FROM (SELECT image_id, comp, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, comp) AS r FROM sz) WHERE r = 1)
SELECT u8.image_id, y, x, b.comp IS NOT NULL AS mask FROM u8 LEFT JOIN lb ON lb.image_id = u8.image_id AND lb.pos = y * 8 + x
LEFT JOIN big b ON b.image_id = lb.image_id AND b.comp = lb.comp""",
)
def _(read):
    # shifted by 60 so that the rasters have an outside; the rule itself is unchanged
    lifted = u8_cells(read).withColumn("g", F.greatest(F.col("v8") - 60.0, F.lit(0.0)))
    return pick(S.fov_mask(lifted, "g", "mask", close=3), "mask")


@query("E11_fov_mask_visible")
def _(read):
    dim = u8_cells(read).withColumns({"g": F.greatest(F.col("v8") - 90.0, F.lit(0.0)), "b": F.greatest(F.col("v8") - 95.0, F.lit(0.0))})
    return pick(S.fov_mask(dim, "g", "mask", "visible", "b", close=3, open_=3), "mask")


@query("E12_thin")
def _(read):
    lines = K.line_points(K.thin(masked_cells(read), "pred", "skel"), "skel")
    return lines.select("image_id", "y", "x", "pred", "skel", "endpoint", "branch")


@query("E12_reconnect")
def _(read):
    return pick(K.reconnect(masked_cells(read), "pred", "fov", "lines", ellipse(3), 3), "lines")


@query(
    "E13_shape_features",
    f"""{STATS}, cs AS (SELECT image_id, CAST(count(*) AS DOUBLE) AS n, avg(area) AS am, CAST(max(area) AS DOUBLE) AS ax, stddev_pop(area) AS asd FROM eg GROUP BY image_id),
w AS (SELECT image_id, greatest(count(*) FILTER (fov), 1) AS nf, count(*) FILTER (pred) AS np, var_pop(x) FILTER (pred) AS px, var_pop(y) FILTER (pred) AS py,
  var_samp(x) FILTER (pred) AS vx, var_samp(y) FILTER (pred) AS vy, covar_samp(x, y) FILTER (pred) AS cxy FROM lab GROUP BY image_id),
e2 AS (SELECT *, (vx + vy) / 2 AS hf, sqrt(pow((vx - vy) / 2, 2) + cxy * cxy) AS rt FROM w)
SELECT image_id, round(CAST(np AS DOUBLE) / nf, 6) AS vessel_density, round(CASE WHEN np > 4 THEN sqrt(px + py) ELSE 0 END, 6) AS vessel_spread,
  round(CASE WHEN np > 4 THEN abs(hf - rt) / (hf + rt + 1e-6) ELSE 0 END, 6) AS vessel_anisotropy, round(coalesce(n, 0), 6) AS n_components,
  round(coalesce(am, 0), 6) AS comp_size_mean, round(coalesce(ax, 0), 6) AS comp_size_max, round(coalesce(asd, 0), 6) AS comp_size_std
FROM e2 LEFT JOIN cs USING (image_id)""",
)
def _(read):
    return rounded(S.shape_features(masked_cells(read), "pred", "fov", skeleton=False))


@query("E13_shape_features_skeleton")
def _(read):
    return rounded(S.shape_features(masked_cells(read), "pred", "fov"))


@query(
    "E14_main_component_features",
    f"""{STATS}, mn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, comp) AS r FROM eg) WHERE r = 1),
cell AS (SELECT lab.image_id, lab.y, lab.x FROM lab JOIN mn USING (image_id, comp)),
ring AS (SELECT m.image_id, avg(m.v) AS rv FROM masked m WHERE fov AND EXISTS (SELECT 1 FROM cell c WHERE c.image_id = m.image_id AND abs(c.y - m.y) <= 4 AND abs(c.x - m.x) <= 4)
  AND NOT EXISTS (SELECT 1 FROM cell c WHERE c.image_id = m.image_id AND c.y = m.y AND c.x = m.x) GROUP BY m.image_id),
w AS (SELECT image_id, greatest(count(*) FILTER (fov), 1) AS nf, count(*) FILTER (pred) AS np, count(DISTINCT comp) AS nc, avg(v) FILTER (fov) AS rm,
  stddev_pop(v) FILTER (fov) AS rs, quantile_cont(v, 0.95) FILTER (fov) AS r95, quantile_cont(v, 0.99) FILTER (fov) AS r99 FROM lab GROUP BY image_id),
k AS (SELECT *, CASE WHEN area <= 2 THEN 1.0 ELSE emax END AS big, CASE WHEN area <= 2 THEN 1.0 ELSE abs(emin) END AS low FROM mn),
e AS (SELECT image_id, y, min(x) AS lo, max(x) AS hi FROM cell GROUP BY ALL),
side AS (SELECT m.image_id, m.y, min(a.lo + coalesce((b.lo - a.lo) * (m.y - a.y) / nullif(b.y - a.y, 0)::DOUBLE, 0)) AS lo,
  max(a.hi + coalesce((b.hi - a.hi) * (m.y - a.y) / nullif(b.y - a.y, 0)::DOUBLE, 0)) AS hi
  FROM e m JOIN e a ON a.image_id = m.image_id AND a.y <= m.y JOIN e b ON b.image_id = m.image_id AND b.y >= m.y GROUP BY ALL),
hull AS (SELECT s.image_id, coalesce(sum((s.hi - s.lo + t.hi - t.lo) / 2), 0) AS hull FROM side s LEFT JOIN side t ON t.image_id = s.image_id AND t.y = s.y + 1 GROUP BY ALL)
SELECT image_id, round(CAST(area AS DOUBLE) / nf, 6) AS ridge_main_area, round(big / (round(low, 9) + 1e-6), 2) AS ridge_main_elong, round(extent, 6) AS ridge_main_extent,
  round(area / (greatest(area, hull) + 1e-6), 6) AS ridge_main_solidity,
  round(4 * sqrt(big) / 8, 6) AS ridge_main_len, round(mean_v - coalesce(rv, 0), 6) AS ridge_main_contrast,
  round(sqrt(pow(cx - 4, 2) + pow(cy - 4, 2)) / (sqrt(128) / 2), 6) AS ridge_center_dist, round(CAST(np AS DOUBLE) / nf, 6) AS ridge_density,
  CAST(nc AS DOUBLE) AS ridge_n_components, round(rm, 6) + 0.0 AS ridge_resp_mean, round(rs, 6) AS ridge_resp_std, round(r95, 6) AS ridge_resp_p95, round(r99, 6) AS ridge_resp_p99
FROM w JOIN k USING (image_id) JOIN hull USING (image_id) LEFT JOIN ring USING (image_id)""",
)
def _(read):
    out = S.main_component_features(cells(read), "v", "fov", skeleton=False)
    return rounded(out.withColumn("ridge_main_elong", F.round("ridge_main_elong", 2)))


@query("E14_main_component_features_skeleton")
def _(read):
    return rounded(S.main_component_features(cells(read), "v", "fov"))


@query("E15_grow_region")
def _(read):
    df = signals(read).withColumns(
        {"seed": F.col("fov") & (F.col("n") > 0.85), "cand": F.col("fov") & (F.col("n") > 0.55)}
    )
    return pick(S.grow_region(df, "seed", "cand", "n", "s", "fov", "grown"), "seed", "grown")
