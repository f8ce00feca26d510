"""Projections and scalar functions (section C)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CELLS, U8, cells, pick, rounded, u8_cells
from cellgrove.functions import colour as K
from cellgrove.functions import strings as S
from cellgrove.operators import cells as G
from cellgrove.operators import contrast as X
from cellgrove.operators.filters import box


@query("C1_to_cells", f"WITH {CELLS} SELECT image_id, y, x, v, fov FROM cells")
def _(read):
    return cells(read).select("image_id", "y", "x", "v", "fov")


@query("C1_from_cells", "SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS arr FROM embeddings")
def _(read):
    return G.from_cells(cells(read), "v").select("image_id", "arr")


@query(
    "C2_grey",
    """SELECT l_orderkey, l_linenumber, round(0.299 * l_quantity + 0.587 * l_discount + 0.114 * l_tax, 6) AS grey,
  greatest(l_quantity, l_discount, l_tax) AS brightest FROM lineitem""",
)
def _(read):
    r, g, b = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return rounded(
        read("lineitem").select("l_orderkey", "l_linenumber", K.grey(r, g, b).alias("grey"), K.brightest(r, g, b).alias("brightest"))
    )


LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query(
    "C3_rgb_to_lab",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS r, l_discount * 10.0 AS g, l_tax * 12.5 AS b FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{LIN.format(c=c)} AS {c}' for c in 'rgb')} FROM t),
z AS (SELECT l_orderkey, l_linenumber, (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456 AS x,
  0.212671 * r + 0.715160 * g + 0.072169 * b AS y, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754 AS z FROM q),
f AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16.0 / 116.0 END AS f{c}' for c in 'xyz')} FROM z)
SELECT l_orderkey, l_linenumber, round(116.0 * fy - 16.0, 5) + 0.0 AS l, round(500.0 * (fx - fy), 5) + 0.0 AS a,
  round(200.0 * (fy - fz), 5) + 0.0 AS b FROM f""",
)
def _(read):
    t = read("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 50.0).alias("r"),
        (F.col("l_discount") * 10.0).alias("g"),
        (F.col("l_tax") * 12.5).alias("b"),
    )
    lab = K.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return rounded(t.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in lab.items()]), 5)


@query("C4_invert_u8", f"WITH {U8} SELECT image_id, y, x, v8, 255.0 - v8 AS inverted, round(v8 / 255.0, 6) AS unit FROM u8")
def _(read):
    v = F.col("v8")
    return pick(u8_cells(read), "v8", K.invert(v).alias("inverted"), K.to_unit(v).alias("unit"))


FUSED = """mixed AS (SELECT *, 0.65 * n + 0.35 * (1.0 - n) * n AS m FROM u8),
e2 AS (SELECT image_id, quantile_cont(m, 0.01) AS lo, quantile_cont(m, 0.99) AS hi, min(m) AS mn, max(m) AS mx
  FROM mixed WHERE fov GROUP BY image_id)"""


@query(
    "C5_fuse",
    f"""WITH {U8}, {FUSED} SELECT image_id, y, x, round(CASE WHEN e2.hi > e2.lo THEN least(greatest((m - e2.lo) / (e2.hi - e2.lo), 0.0), 1.0)
  WHEN e2.mx > e2.mn THEN least(greatest((m - e2.mn) / (e2.mx - e2.mn), 0.0), 1.0) ELSE 0.0 END, 6) AS fused
FROM mixed JOIN e2 USING (image_id)""",
)
def _(read):
    maps = u8_cells(read).withColumn("g", (1.0 - F.col("n")) * F.col("n"))
    return pick(X.fuse(maps, {"n": 0.65, "g": 0.35}, "fov", "fused"), "fused")


@query("C5_gated", f"WITH {U8} SELECT image_id, y, x, round(n * (0.45 + 0.55 * (1.0 - n)) * (0.65 + 0.35 * n), 6) AS gated FROM u8")
def _(read):
    maps = u8_cells(read).withColumn("s", 1.0 - F.col("n"))
    return pick(maps, X.gated("n", [("s", 0.45, 0.55), ("n", 0.65, 0.35)]).alias("gated"))


BOXED = """bg AS (SELECT c.image_id, c.y, c.x, c.fov, c.v8, avg(n.v8) AS bg FROM u8 c
  CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) a CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx) b
  JOIN u8 n ON n.image_id = c.image_id AND n.y = CASE WHEN c.y + dy < 0 THEN -1 - (c.y + dy) WHEN c.y + dy > 7 THEN 15 - (c.y + dy) ELSE c.y + dy END
    AND n.x = CASE WHEN c.x + dx < 0 THEN -1 - (c.x + dx) WHEN c.x + dx > 7 THEN 15 - (c.x + dx) ELSE c.x + dx END
  GROUP BY ALL)"""


def with_background(read):
    return box(u8_cells(read), "v8", 3, "reflect", "bg")


@query(
    "C6_residual_contrast",
    f"""WITH {U8}, {BOXED}, s AS (SELECT image_id, median(v8 - bg) AS mid, quantile_cont(v8 - bg, 0.01) AS lo, quantile_cont(v8 - bg, 0.99) AS hi
  FROM bg WHERE fov GROUP BY image_id),
r AS (SELECT image_id, y, x, fov, least(greatest(round(mid - (v8 - bg), 9) / greatest(mid - lo, 1.0), 0.0), 1.0) AS dark,
  least(greatest(round(v8 - bg - mid, 9) / greatest(hi - mid, 1.0), 0.0), 1.0) AS bright FROM bg JOIN s USING (image_id))
SELECT image_id, y, x, CASE WHEN fov THEN floor(least(greatest(round(142.0 - 118.0 * pow(dark, 0.72) + 34.0 * pow(bright, 1.55), 9), 0.0), 255.0)) ELSE 0.0 END AS bent FROM r""",
)
def _(read):
    return pick(X.residual_contrast(with_background(read), "v8", "bg", "fov", "fov", "bent"), "bent")


@query(
    "C7_flatten",
    f"""WITH {U8}, {BOXED}, s AS (SELECT image_id, quantile_cont(v8 - bg, 0.01) AS lo, median(v8) AS med FROM bg WHERE fov GROUP BY image_id)
SELECT image_id, y, x, CASE WHEN fov THEN floor(least(greatest(round(v8 / greatest(bg, 1.0) * 128.0, 9), 0.0), 255.0)) ELSE 0.0 END AS divided,
  CASE WHEN fov THEN floor(least(greatest(round(v8 - bg - lo, 9), 0.0), 255.0)) ELSE 0.0 END AS subtracted,
  round(v8 * med / greatest(bg, 1.0), 10) AS levelled FROM bg JOIN s USING (image_id)""",
)
def _(read):
    df = with_background(read)
    df = X.flatten(df, "v8", "bg", "fov", "divide", "divided")
    df = X.flatten(df, "v8", "bg", "fov", "subtract", "subtracted")
    return pick(X.flatten(df, "v8", "bg", "fov", "divide_median", "levelled"), "divided", "subtracted", "levelled", digits=10)


@query("C8_flip", f"WITH {CELLS} SELECT image_id, y, 7 - x AS x, v FROM cells UNION ALL SELECT image_id + 1000000, 7 - y, x, v FROM cells")
def _(read):
    df = cells(read)
    down = G.flip(df, "vertical").withColumn("image_id", F.col("image_id") + 1000000)
    return G.flip(df, "horizontal").unionByName(down).select("image_id", "y", "x", "v")


@query("C8_rot90", f"WITH {CELLS} SELECT image_id, 7 - x AS y, y AS x, v FROM cells")
def _(read):
    return G.rot90(cells(read), 1).select("image_id", "y", "x", "v")


_A, _B = 1.1 * math.cos(math.radians(12)), 1.1 * math.sin(math.radians(12))


@query(
    "C9_affine_resample",
    f"""WITH {CELLS}, t AS (SELECT image_id, y, x, ((x - 4.0) * {_A!r}::DOUBLE - (y - 4.0) * {_B!r}::DOUBLE) / {_A * _A + _B * _B!r}::DOUBLE + 4.0 AS sx,
  ((x - 4.0) * {_B!r}::DOUBLE + (y - 4.0) * {_A!r}::DOUBLE) / {_A * _A + _B * _B!r}::DOUBLE + 4.0 AS sy FROM cells),
p AS (SELECT t.*, i, j, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS wt
  FROM t, (SELECT unnest(range(2)) AS i) a, (SELECT unnest(range(2)) AS j) b)
SELECT p.image_id, p.y, p.x, round(sum(wt * coalesce(c.v, 0.0)), 6) + 0.0 AS r FROM p LEFT JOIN cells c
  ON c.image_id = p.image_id AND c.x = floor(sx) + i AND c.y = floor(sy) + j GROUP BY p.image_id, p.y, p.x""",
)
def _(read):
    return pick(G.affine_resample(cells(read), "v", 12.0, 1.1, "r"), "r")


@query("C10_block_mean", f"WITH {CELLS} SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) + 0.0 AS m FROM cells GROUP BY ALL")
def _(read):
    return pick(G.block_mean(cells(read), "v", 2, "m"), "m")


@query(
    "C10_nearest",
    f"""WITH {CELLS} SELECT c.image_id, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, v FROM cells c,
  (SELECT unnest(range(5)) AS ty) a, (SELECT unnest(range(12)) AS tx) b WHERE c.y = ty * 8 // 5 AND c.x = tx * 8 // 12""",
)
def _(read):
    return G.nearest(cells(read), 5, 12).select("image_id", "y", "x", "v")


@query(
    "C10_resized_dims",
    """SELECT p_partkey, CAST(round_even(p_size * least(1.0, 20.0 / greatest(p_size, 37)), 0) AS INTEGER) AS h_round,
  CAST(floor(p_size * least(1.0, 20.0 / greatest(p_size, 37))) AS INTEGER) AS h_trunc FROM part""",
)
def _(read):
    part = read("part").select("p_partkey", F.col("p_size").alias("h"), F.lit(37).alias("w"))
    return part.select(
        "p_partkey", G.resized_dims(20, "round")[0].alias("h_round"), G.resized_dims(20, "truncate")[0].alias("h_trunc")
    )


@query(
    "C13_strings",
    r"""WITH f AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(url, '([^/]*)/[^/]*$', 1) AS parent,
  replace(concat('Stage 1', '_', regexp_replace(name, '^(.+)\.[^.]*$', '\1')), ' ', '_') AS key,
  regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS tag, printf('%+.2f', page_id / 7.0) AS signed FROM f""",
)
def _(read):
    url = F.col("url")
    return read("pages").select(
        "page_id",
        S.stem(url).alias("stem"),
        S.parent(url).alias("parent"),
        S.key(F.lit("Stage 1"), url).alias("key"),
        S.tag(url).alias("tag"),
        S.signed(F.col("page_id") / 7.0).alias("signed"),
    )
