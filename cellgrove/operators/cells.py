"""The cell table: one row per raster cell.

Columns ``image_id, h, w, y, x`` plus any number of value (double) and mask
(boolean) columns. ``h`` and ``w`` are the raster's dimensions, carried on
every row so that borders and size rules need no lookup.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.quantiles import MAX_CELLS, MAX_SIDE, Spec, group_stats, small_rasters, window_stats
from cellgrove.session import shared, spread

KEY = ["image_id", "y", "x"]
FRAME = ["image_id", "h", "w"]
GRID = ["image_id", "h", "w", "y", "x"]
#: Bound on a raster's cell count, known from its own row.
SIZE = "cast(h as bigint) * w"
#: Cells that one task makes of a source; windows hold a few kilobytes for each before they shuffle.
TASK_CELLS = 1 << 16


def bound(h: int, w: int) -> dict[str, int]:
    """Metadata of column ``h`` where no raster of a table is larger than this."""
    return {MAX_CELLS: h * w, MAX_SIDE: max(h, w)}


def to_cells(df: DataFrame, id_col: str, arr_col: str, w: int, h: int, out: str = "v") -> DataFrame:
    """Explode a row-major array column into cells, ``TASK_CELLS`` or so in a task."""
    flat = spread(df.select(id_col, arr_col), id_col, max(1, TASK_CELLS // (w * h))).select(F.col(id_col).alias("image_id"), F.posexplode(arr_col).alias("_pos", "_v"))
    return flat.select(
        "image_id",
        F.lit(h).alias("h", metadata=bound(h, w)),
        F.lit(w).alias("w"),
        F.floor(F.col("_pos") / w).cast("int").alias("y"),
        (F.col("_pos") % w).cast("int").alias("x"),
        F.col("_v").cast("double").alias(out),
    )


def from_cells(df: DataFrame, value: str, out: str = "arr") -> DataFrame:
    """Cells back to one row-major array per image (one raster per row)."""
    packed = F.array_sort(F.collect_list(F.struct("y", "x", value)))
    return df.groupBy(*FRAME).agg(F.transform(packed, lambda s: s[value]).alias(out))


def position(y="y", x="x") -> Column:
    """Row-major position of a cell inside its raster."""
    return F.col(y).cast("long") * F.col("w") + F.col(x)


def join_stats(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach per-image statistics; the planner picks the join from their size.

    A raster with a third of all cells makes one hot key on the cell side, which
    adaptive skew splitting handles because the statistics side has one row.
    """
    return cells.join(stats, "image_id", "left")


def with_stats(cells: DataFrame, percentiles: dict[str, Spec], aggs: dict[str, Column] | None = None) -> DataFrame:
    """The cells with the statistics of their image (see ``group_stats``) as columns.

    Small rasters get them from a window: one pass over the cells and one shuffle
    for all such steps in a row, where a join reads and shuffles the cells twice a step.
    """
    if small_rasters(cells):
        return window_stats(cells, percentiles, aggs or {})
    return join_stats(cells, group_stats(cells, ["image_id"], percentiles, aggs, SIZE))


def settled(cells: DataFrame) -> DataFrame:
    """The cells as a written table, unless the steps on them read small rasters only once."""
    return cells if small_rasters(cells) else shared(cells)


def flip(df: DataFrame, axis: str) -> DataFrame:
    if axis == "horizontal":
        return df.withColumn("x", F.col("w") - 1 - F.col("x"))
    if axis == "vertical":
        return df.withColumn("y", F.col("h") - 1 - F.col("y"))
    raise ValueError(axis)


def rot90(df: DataFrame, k: int = 1) -> DataFrame:
    """Rotate counter-clockwise by k quarter turns."""
    for _ in range(k % 4):
        df = df.withColumns(
            {
                "y": F.col("w") - 1 - F.col("x"),
                "x": F.col("y"),
                "h": F.col("w"),
                "w": F.col("h"),
            }
        )
    return df


def affine_resample(df: DataFrame, value: str, angle_deg: float, scale: float, out: str) -> DataFrame:
    """Rotate and scale about the centre, bilinear, zero outside.

    Every target cell asks for its four source neighbours; the requests are
    joined to the cells by key and the weighted values summed back per target.
    """
    a = scale * math.cos(math.radians(angle_deg))
    b = scale * math.sin(math.radians(angle_deg))
    det = a * a + b * b
    cy, cx = F.col("h") / 2.0, F.col("w") / 2.0
    dx, dy = F.col("x") - cx, F.col("y") - cy
    target = df.select(
        *GRID,
        ((dx * a - dy * b) / det + cx).alias("_sx"),
        ((dx * b + dy * a) / det + cy).alias("_sy"),
    )
    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    corners = F.array(
        *[
            F.struct(
                (F.floor("_sy") + j).cast("int").alias("qy"),
                (F.floor("_sx") + i).cast("int").alias("qx"),
                ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("wt"),
            )
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    asked = target.select(*GRID, F.explode(corners).alias("_c")).select(*GRID, "_c.*")
    source = df.select(
        F.col("image_id"), F.col("y").alias("qy"), F.col("x").alias("qx"), F.col(value).alias("_v")
    )
    return (
        asked.join(source, ["image_id", "qy", "qx"], "left")
        .groupBy(*GRID)
        .agg(F.sum(F.col("wt") * F.coalesce("_v", F.lit(0.0))).alias(out))
    )


def block_mean(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Down-sample by averaging k x k blocks."""
    return df.groupBy(
        "image_id",
        F.ceil(F.col("h") / k).cast("int").alias("h"),
        F.ceil(F.col("w") / k).cast("int").alias("w"),
        F.floor(F.col("y") / k).cast("int").alias("y"),
        F.floor(F.col("x") / k).cast("int").alias("x"),
    ).agg(F.avg(value).alias(out))


def nearest(df: DataFrame, new_h: int, new_w: int) -> DataFrame:
    """Nearest-cell resampling: target t reads source floor(t * old / new)."""
    def targets(axis, size, new):
        # targets whose source is this cell: ceil(s*new/size) .. ceil((s+1)*new/size)-1
        lo = F.ceil(F.col(axis) * new / F.col(size)).cast("int")
        hi = F.ceil((F.col(axis) + 1) * new / F.col(size)).cast("int") - 1
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    keep = [c for c in df.columns if c not in GRID]
    return (
        df.withColumn("_ty", F.explode(targets("y", "h", new_h)))
        .withColumn("_tx", F.explode(targets("x", "w", new_w)))
        .select(
            "image_id",
            F.lit(new_h).alias("h", metadata=bound(new_h, new_w)),
            F.lit(new_w).alias("w"),
            F.col("_ty").alias("y"),
            F.col("_tx").alias("x"),
            *keep,
        )
    )


def resized_dims(max_side: int, rule: str) -> tuple[Column, Column]:
    """Height and width after limiting the longer side, with either rounding rule."""
    longest = F.greatest("h", "w")
    factor = F.least(F.lit(1.0), F.lit(float(max_side)) / longest)
    if rule == "round":
        return F.bround(F.col("h") * factor).cast("int"), F.bround(F.col("w") * factor).cast("int")
    if rule == "truncate":
        return F.floor(F.col("h") * factor).cast("int"), F.floor(F.col("w") * factor).cast("int")
    raise ValueError(rule)
