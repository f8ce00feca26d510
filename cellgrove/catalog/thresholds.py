"""Threshold and hysteresis queries (section G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CELLS, MASKED, U8, cells, masked_cells, pick, rounded, u8_cells, window_sql
from cellgrove.functions.kernels import square
from cellgrove.operators import threshold as G
from cellgrove.operators.masked import normalise

BASE = """pos AS (SELECT image_id, y, x, n AS v FROM u8 WHERE fov AND n > 0),
base AS (SELECT image_id, quantile_cont(v, 0.88) AS q, count(*) AS cnt, max(v) - min(v) AS rng, min(v) AS lo, max(v) AS hi FROM pos GROUP BY image_id)"""
HIST = """hb AS (SELECT image_id, CAST(least(floor((v - lo) / (hi - lo) * 32), 31) AS INTEGER) AS bin, count(*) AS c FROM pos JOIN base USING (image_id) GROUP BY ALL),
h AS (SELECT b.image_id, b.lo, b.hi, k.bin, coalesce(hb.c, 0) AS c FROM base b CROSS JOIN (SELECT CAST(unnest(range(32)) AS INTEGER) AS bin) k LEFT JOIN hb ON hb.image_id = b.image_id AND hb.bin = k.bin)"""
OTSU = """cm AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 32 AS ctr, sum(c) OVER u AS w1, sum(c * (lo + (bin + 0.5) * (hi - lo) / 32)) OVER u AS s1,
  sum(c) OVER a AS w, sum(c * (lo + (bin + 0.5) * (hi - lo) / 32)) OVER a AS s FROM h
  WINDOW u AS (PARTITION BY image_id ORDER BY bin), a AS (PARTITION BY image_id)),
tt AS (SELECT image_id, arg_max(ctr, (round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 9), -bin)) AS t FROM cm WHERE w1 > 0 AND w > w1 GROUP BY image_id)"""
TRIANGLE = """sh AS (SELECT image_id, arg_max(bin, (c, -bin)) AS peak, max(c) AS top, min(bin) FILTER (c > 0) AS f, max(bin) FILTER (c > 0) AS l FROM h GROUP BY image_id),
wd AS (SELECT *, peak - f < l - peak AS rt, CASE WHEN peak - f < l - peak THEN l - peak ELSE peak - f END AS width FROM sh),
al AS (SELECT h.*, wd.top, wd.width, CASE WHEN rt THEN l - bin ELSE bin - f END AS along FROM h JOIN wd USING (image_id)),
tt AS (SELECT image_id, arg_max(lo + (bin + 0.5) * (hi - lo) / 32, (round((top * along - width * c) / sqrt(top * top + width * width), 9), -along)) AS t
  FROM al WHERE along >= 0 AND along < width GROUP BY image_id)"""
USABLE = "cnt >= 16 AND rng >= 1e-6"


def _cut(read, method):
    return rounded(G.cutoff(u8_cells(read), "n", "fov", method, 0.12, bins=32))


@query("G1_density_threshold", f"""WITH {U8}, {BASE} SELECT u8.image_id, y, x, fov AND n >= CASE WHEN {USABLE} THEN q ELSE 0.5 END AS top FROM u8 JOIN base USING (image_id)""")
def _(read):
    return pick(G.threshold(u8_cells(read), "n", "fov", "percentile", 0.12, "top"), "top")


@query("G2_otsu", f"WITH {U8}, {BASE}, {HIST}, {OTSU} SELECT image_id, round(CASE WHEN {USABLE} THEN coalesce(t, q) ELSE 0.5 END, 6) AS cutoff FROM base LEFT JOIN tt USING (image_id)")
def _(read):
    return _cut(read, "otsu")


@query("G3_triangle", f"WITH {U8}, {BASE}, {HIST}, {TRIANGLE} SELECT image_id, round(CASE WHEN {USABLE} THEN coalesce(t, q) ELSE 0.5 END, 6) AS cutoff FROM base LEFT JOIN tt USING (image_id)")
def _(read):
    return _cut(read, "triangle")


@query("G4_hybrid", f"WITH {U8}, {BASE}, {HIST}, {TRIANGLE} SELECT image_id, round(CASE WHEN {USABLE} THEN least(coalesce(t, q), q) ELSE 0.5 END, 6) AS cutoff FROM base LEFT JOIN tt USING (image_id)")
def _(read):
    return _cut(read, "hybrid")


@query(
    "G5_elbow_density",
    f"""WITH {U8}, pos AS (SELECT image_id, y, x, n AS v FROM u8 WHERE fov AND n > 0),
c AS (SELECT image_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY image_id) AS cnt, sum(v) OVER w AS s, sum(v) OVER (PARTITION BY image_id) AS t
  FROM pos WINDOW w AS (PARTITION BY image_id ORDER BY v, y, x ROWS UNBOUNDED PRECEDING)),
e AS (SELECT image_id, cnt, arg_max(k, (round(abs(s / t - CAST(k AS DOUBLE) / cnt), 12), -k)) AS knee FROM c GROUP BY image_id, cnt)
SELECT image_id, round(CASE WHEN cnt >= 20 THEN greatest(0.06, least(0.6, 1.0 - CAST(knee AS DOUBLE) / cnt)) ELSE 0.5 END, 6) AS density FROM e""",
)
def _(read):
    return rounded(G.elbow_density(u8_cells(read), "n", "fov", 0.06, 0.6, least=20))


@query(
    "G6_sauvola",
    f"""WITH {U8}, m AS ({window_sql('u8', square(5), 'reflect101', 'avg(n.n) AS m, avg(n.n * n.n) AS q')})
SELECT image_id, y, x, round(m * (1.0 + 0.05 * (sqrt(greatest(q - m * m, 0)) / 0.5 - 1.0)), 6) AS t FROM m""",
)
def _(read):
    return pick(G.sauvola(u8_cells(read), "n", 5, 0.05, 0.5, "t"), "t")


@query(
    "G6_local_adaptive",
    f"""WITH {U8}, sg AS (SELECT *, 1.0 - abs(n - 0.6) AS s FROM u8), m AS ({window_sql('u8', square(5), 'reflect101', 'avg(n.n) AS m, avg(n.n * n.n) AS q')}),
fl AS (SELECT image_id, greatest(0.02, quantile_cont(n, 0.35)) AS fn, greatest(0.02, quantile_cont(s, 0.35)) AS fs FROM sg WHERE fov GROUP BY image_id),
ct AS (SELECT image_id, coalesce(quantile_cont(n, 0.78) FILTER (n > fn), quantile_cont(n, 0.78)) AS g, coalesce(quantile_cont(s, 0.48) FILTER (s > fs), quantile_cont(s, 0.48)) AS sf
  FROM sg JOIN fl USING (image_id) WHERE fov GROUP BY image_id)
SELECT image_id, y, x, fov AND n >= greatest(m * (1.0 + 0.05 * (sqrt(greatest(q - m * m, 0)) / 0.5 - 1.0)) + 0.03, g) AND s >= sf AS m
FROM sg JOIN m USING (image_id, y, x) JOIN ct USING (image_id)""",
)
def _(read):
    df = u8_cells(read).withColumn("s", 1.0 - F.abs(F.col("n") - 0.6))
    return pick(G.local_adaptive(df, "n", "s", "fov", "m", window=5), "m")


def reach_sql(weak, steps):
    near = {8: "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1", 4: "abs(a.y - b.y) + abs(a.x - b.x) <= 1"}[steps]
    return f"""m AS (SELECT image_id, y, x, y * 8 + x AS pos, st FROM marked WHERE {weak}),
reach AS (SELECT image_id, pos, pos AS comp FROM m UNION SELECT b.image_id, b.pos, r.comp FROM reach r JOIN m a ON a.image_id = r.image_id AND a.pos = r.pos
  JOIN m b ON b.image_id = a.image_id AND {near} WHERE r.comp < b.pos),
lb AS (SELECT image_id, pos, min(comp) AS comp FROM reach GROUP BY ALL),
good AS (SELECT image_id, comp, bool_or(st) AS ok, count(*) AS area FROM m JOIN lb USING (image_id, pos) GROUP BY image_id, comp),
hy AS (SELECT k.image_id, k.y, k.x, k.fov, k.st, k.wk, coalesce(g.ok, false) AS hit, coalesce(g.area, 0) AS area FROM marked k
  LEFT JOIN lb ON lb.image_id = k.image_id AND lb.pos = k.y * 8 + k.x LEFT JOIN good g ON g.image_id = lb.image_id AND g.comp = lb.comp)"""


@query(
    "G7_hysteresis_fixed",
    f"""WITH RECURSIVE {U8}, marked AS (SELECT image_id, y, x, fov, fov AND n >= 0.8 AS st, fov AND n >= 0.5 AS wk FROM u8), {reach_sql('wk', 8)}
SELECT image_id, y, x, hit AS mask FROM hy""",
)
def _(read):
    return pick(G.fixed_levels(u8_cells(read), "n", "fov", 0.8, 0.5, "mask"), "mask")


@query(
    "G7_hysteresis_density",
    f"""WITH RECURSIVE {U8}, lv AS (SELECT image_id, quantile_cont(n, 1.0 - least(greatest(0.115 * 1.45, 0.015), 0.20)) AS lo, quantile_cont(n, 1.0 - least(greatest(0.115 * 0.60, 0.008), 0.115 * 1.45 * 0.85)) AS hi
  FROM u8 WHERE fov GROUP BY image_id),
marked AS (SELECT u8.image_id, y, x, fov, fov AND n >= hi AS st, fov AND n >= lo AS wk FROM u8 JOIN lv USING (image_id)), {reach_sql('wk', 8)},
alive AS (SELECT image_id, bool_or(hit AND area >= 8) AS ok FROM hy GROUP BY image_id)
SELECT image_id, y, x, CASE WHEN ok THEN hit AND area >= 8 ELSE st END AND fov AS mask FROM hy JOIN alive USING (image_id)""",
)
def _(read):
    out = G.density_hysteresis(u8_cells(read), "n", "fov", "mask", 0.115, 1.45, 0.60)
    return pick(out, "mask")


HIST4 = """hb AS (SELECT image_id, CAST(least(floor((v - lo) / (hi - lo) * {b}), {b} - 1) AS INTEGER) AS bin, count(*) AS c FROM pos JOIN base USING (image_id) GROUP BY ALL),
h AS (SELECT b.image_id, b.lo, b.hi, k.bin, coalesce(hb.c, 0) AS c FROM base b CROSS JOIN (SELECT CAST(unnest(range({b})) AS INTEGER) AS bin) k LEFT JOIN hb ON hb.image_id = b.image_id AND hb.bin = k.bin)"""


@query(
    "G7_hysteresis_triangle",
    f"""WITH RECURSIVE {U8}, pos AS (SELECT image_id, y, x, n AS v FROM u8 WHERE fov),
base AS (SELECT image_id, quantile_cont(v, 0.90) AS q, quantile_cont(v, 0.75) AS q75, min(v) AS lo, max(v) AS hi FROM pos GROUP BY image_id), {HIST4.format(b=8)}, {TRIANGLE.replace('/ 32', '/ 8')},
lv AS (SELECT image_id, greatest(coalesce(t, q), q) AS hi2, greatest(greatest(coalesce(t, q), q) * 0.70, q75) AS lo2 FROM base LEFT JOIN tt USING (image_id)),
marked AS (SELECT u8.image_id, y, x, fov, fov AND n >= hi2 AS st, fov AND n >= lo2 AS wk FROM u8 JOIN lv USING (image_id)), {reach_sql('wk', 4)}
SELECT image_id, y, x, hit AS mask FROM hy""",
)
def _(read):
    return pick(G.triangle_hysteresis(u8_cells(read), "n", "fov", "mask"), "mask")


@query("G7_hysteresis_adaptive")
def _(read):
    df = u8_cells(read)
    at = df.join(G.adaptive_levels(df, "n", "fov", 32, least=20), "image_id")
    marked = at.withColumns({"st": F.col("fov") & (F.col("n") >= F.col("high")), "wk": F.col("fov") & (F.col("n") >= F.col("low"))})
    return pick(G.hysteresis(marked, "st", "wk", "mask"), "mask")


@query("G7_hysteresis_evidence")
def _(read):
    df = u8_cells(read).withColumn("e", F.sqrt("n") * 0.9)
    return pick(G.evidence_hysteresis(df, "n", "e", "fov", "mask"), "mask")


@query("G7_connected_levels")
def _(read):
    df = u8_cells(read).withColumn("s", 1.0 - F.abs(F.col("n") - 0.8))
    return pick(G.connected_levels(df, "n", "fov", "mask", 0.8, 0.5, 4, "s", 0.12), "mask")


@query(
    "G10_mask_algebra",
    f"WITH {MASKED} SELECT image_id, y, x, pred AND gt AS both_masks, pred OR gt AS either, pred AND NOT gt AS only_pred FROM masked",
)
def _(read):
    return masked_cells(read).select(
        "image_id",
        "y",
        "x",
        G.mask_and("pred", "gt").alias("both_masks"),
        G.mask_or("pred", "gt").alias("either"),
        G.mask_minus("pred", "gt").alias("only_pred"),
    )
