"""Rows that several queries start from, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.functions.logits import argmax
from cellgrove.operators.cells import to_cells, with_stats

SEED = 42
CLASSES = [0, 1, 2, 3, 4]


def cells(read):
    """Each embedding as an 8 x 8 raster with a field of view that lacks the corners."""
    grid = to_cells(read("embeddings"), "vec_id", "embedding", 8, 8)
    return grid.withColumn("fov", ~(F.col("y").isin(0, 7) & F.col("x").isin(0, 7)))


CELLS = """cells AS (
  SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
         CAST(embedding[i] AS DOUBLE) AS v,
         NOT ((i - 1) // 8 IN (0, 7) AND (i - 1) % 8 IN (0, 7)) AS fov
  FROM embeddings, range(1, 65) t(i))"""


def masked_cells(read, p=0.84):
    """``pred``: top of each raster inside the field of view; ``gt``: the same of the left neighbour."""
    from cellgrove.operators.neighbourhood import neighbourhood

    shifted = neighbourhood(
        cells(read), [(0, -1)], {"left": F.max(F.when(F.col("dx") == -1, F.col("v")))}, "constant"
    )
    return with_stats(shifted, {"t": (F.when(F.col("fov"), F.col("v")), p)}).select(
        "image_id",
        "h",
        "w",
        "y",
        "x",
        "v",
        "fov",
        (F.col("fov") & (F.col("v") >= F.col("t"))).alias("pred"),
        (F.col("fov") & F.coalesce(F.col("left") >= F.col("t"), F.lit(False))).alias("gt"),
    )


MASKED = (
    CELLS
    + """, cutoffs AS (SELECT image_id, quantile_cont(v, 0.84) AS t FROM cells WHERE fov GROUP BY image_id),
masked AS (
  SELECT c.*, c.fov AND c.v >= t AS pred, c.fov AND coalesce(l.v >= t, false) AS gt
  FROM cells c JOIN cutoffs USING (image_id)
  LEFT JOIN cells l ON l.image_id = c.image_id AND l.y = c.y AND l.x = c.x - 1)"""
)

#: mask components by repeated minimum over 8 neighbours; comp is the lowest position
LABELS = """labels8 AS (
  WITH RECURSIVE m AS (SELECT image_id, y, x, y * 8 + x AS pos FROM masked WHERE pred),
  reach AS (
    SELECT image_id, pos, pos AS comp FROM m
    UNION
    SELECT b.image_id, b.pos, r.comp FROM reach r JOIN m a ON a.image_id = r.image_id AND a.pos = r.pos
    JOIN m b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
    WHERE r.comp < b.pos)
  SELECT image_id, pos, min(comp) AS comp FROM reach GROUP BY ALL)"""


def oof(read):
    """Out-of-fold table: five scores per vector, class id, prediction, fold."""
    from cellgrove.operators.folds import stratified_kfold

    rows = read("embeddings").select(
        F.col("vec_id").alias("key"),
        (F.col("label") % 5).cast("int").alias("label_id"),
        F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")).alias("logits"),
    )
    folded = stratified_kfold(rows, "label_id", "key", 5, SEED)
    return folded.withColumn("pred", argmax(F.col("logits")))


OOF = f"""oof AS (
  SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
         CAST((row_number() OVER (PARTITION BY label_id ORDER BY md5(concat(key, ':{SEED}')), key) - 1) % 5
              AS INTEGER) AS fold
  FROM (SELECT vec_id AS key, CAST(label % 5 AS INTEGER) AS label_id,
               CAST(embedding[1:5] AS DOUBLE[]) AS logits FROM embeddings))"""

PER_CLASS = """SELECT k.cls, count(*) FILTER (label_id = k.cls AND pred = k.cls) AS tp,
  count(*) FILTER (label_id = k.cls) AS support, count(*) FILTER (pred = k.cls) AS predicted"""


def rounded(df, digits=6):
    """Doubles rounded the same way on both sides of a comparison."""
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double":
            df = df.withColumn(f.name, F.round(f.name, digits))
    return df


def u8_cells(read):
    """Each raster scaled to whole numbers 0..255."""
    from cellgrove.functions.colour import to_u8
    from cellgrove.operators.masked import normalise

    scaled = normalise(cells(read), "v", "fov", "n")
    return scaled.withColumn("v8", to_u8(F.col("n")))


U8 = (
    CELLS
    + """, edges AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi,
  min(v) AS mn, max(v) AS mx FROM cells WHERE fov GROUP BY image_id),
u8 AS (SELECT c.*, n, floor(n * 255.0) AS v8 FROM (SELECT c.*,
  CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0.0), 1.0)
       WHEN mx > mn THEN least(greatest((v - mn) / (mx - mn), 0.0), 1.0) ELSE 0.0 END AS n
  FROM cells c JOIN edges USING (image_id)) c)"""
)

_FOLD = {
    "reflect": "least((({u}) % 16 + 16) % 16, 15 - (({u}) % 16 + 16) % 16)",
    "reflect101": "least((({u}) % 14 + 14) % 14, 14 - (({u}) % 14 + 14) % 14)",
    "replicate": "least(greatest({u}, 0), 7)",
    "constant": "{u}",
}


def window_sql(table: str, taps: list[tuple], border: str, aggs: str, where: str = "true") -> str:
    """Stencil over an 8 x 8 raster: c is the target, n the cell read, k the tap (dy, dx, w0, ...)."""
    width = len(taps[0])
    names = ", ".join(["dy", "dx", *[f"w{i}" for i in range(width - 2)]])
    rows = ", ".join("(" + ", ".join(f"{t}" if i < 2 else f"{t!r}::DOUBLE" for i, t in enumerate(tap)) + ")" for tap in taps)
    fold = _FOLD[border]
    return f"""SELECT c.image_id, c.y, c.x, {aggs} FROM {table} c CROSS JOIN (VALUES {rows}) k({names})
  JOIN {table} n ON n.image_id = c.image_id AND n.y = {fold.format(u='c.y + k.dy')} AND n.x = {fold.format(u='c.x + k.dx')}
  WHERE {where} GROUP BY c.image_id, c.y, c.x"""


def taps_of(*kernels):
    """Taps of one or more kernel tables over their joint support."""
    support = sorted({k for ker in kernels for k in ker})
    return [(*k, *[ker.get(k, 0.0) for ker in kernels]) for k in support]


def pick(df, *cols, digits=6):
    return rounded(df.select("image_id", "y", "x", *cols), digits)
