"""Nearest cells by exact Euclidean distance, whatever the distance.

Two passes, as for the classical linear-time transform. Along each column a window
finds the nearest wanted cell. Along each raster row these are parabolas over x,
and their lower envelope gives the nearest one to every cell; rows are handled in
bands of bounded size, all rows of a band together. No radius and no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from cellgrove.operators.quantiles import small_rasters
from cellgrove.operators.tiles import alike, over_groups

#: Cells of a band of raster rows; a band has at least one row.
BAND_CELLS = 1 << 18


def lower_envelope(offsets: np.ndarray, valid: np.ndarray, unit: int) -> np.ndarray:
    """For every row and place x, the place i that minimises unit * (x - i)**2 + offsets[row, i].

    Only valid places compete; -1 where a row has none. Whole numbers throughout
    (an object array for ones beyond 64 bits), so that ties stay ties. All rows
    go through the places together.
    """
    rows, width = offsets.shape
    site, start = np.zeros((rows, width), np.int64), np.zeros((rows, width), np.int64)
    top = np.full(rows, -1)
    exact = lambda v: np.asarray(v).astype(offsets.dtype)
    cost = lambda r, x, i: unit * exact(x - i) ** 2 + offsets[r, i]
    for q in range(width):
        on = np.flatnonzero(valid[:, q])
        todo = on[top[on] >= 0]
        while len(todo):
            x, i = start[todo, top[todo]], site[todo, top[todo]]
            todo = todo[(cost(todo, x, i) > cost(todo, x, q)).astype(bool)]
            top[todo] -= 1
            todo = todo[top[todo] >= 0]
        first, later = on[top[on] < 0], on[top[on] >= 0]
        top[first] = 0
        site[first, 0], start[first, 0] = q, 0
        if len(later):
            i = site[later, top[later]]
            meet = (unit * exact(q * q - i * i) + offsets[later, q] - offsets[later, i]) // (2 * unit * exact(q - i)) + 1
            ahead = (meet < width).astype(bool)
            later = later[ahead]
            top[later] += 1
            site[later, top[later]], start[later, top[later]] = q, meet[ahead].astype(np.int64)
    out = np.full((rows, width), -1, np.int64)
    some = np.flatnonzero(top >= 0)
    for x in range(width - 1, -1, -1):
        out[some, x] = site[some, top[some]]
        top[some] -= start[some, top[some]] == x
    return out


def _in_column(df: DataFrame, valid: Column, payload: list[str]) -> DataFrame:
    """Nearest wanted cell of the same column (upper one on ties) as ``_src``."""
    column = Window.partitionBy("image_id", "x").orderBy("y")
    here = F.when(valid, F.struct(F.col("y").alias("sy"), *[F.col(c).alias(f"s_{c}") for c in payload]))
    above = F.last(here, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(here, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    tagged = df.withColumns({"_up": above, "_dn": below})
    up, dn = F.col("_up"), F.col("_dn")
    nearer = F.when(dn.isNull() | (F.col("y") - up["sy"] <= dn["sy"] - F.col("y")), up).otherwise(dn)
    return tagged.withColumn("_src", F.coalesce(nearer, dn)).drop("_up", "_dn")


def nearest(df: DataFrame, valid: Column, payload: list[str] = ()) -> DataFrame:
    """Adds of the nearest cell where ``valid`` holds: ``_d2`` (squared distance), ``_sy``, ``_sx``, ``_s_<payload>``.

    Ties go to the smaller row, then column. All are null in a raster without
    such a cell. Cells that the table lacks are neither found nor returned.
    """
    single = small_rasters(df)  # one band each: both passes share the partitions of the image
    passed = _in_column(df.repartition("image_id") if single else df, valid, list(payload))
    found = [F.col("_src.sy").alias("_sy"), *[F.col(f"_src.s_{c}").alias(f"_s_{c}") for c in payload]]
    passed = passed.select(*df.columns, *found, F.floor(F.col("y") / F.greatest(F.lit(1), F.floor(F.lit(BAND_CELLS) / F.col("w")))).alias("_band"))
    added = [StructField("_d2", LongType()), StructField("_sx", IntegerType())]
    names = [*passed.drop("_band").columns, "_d2", "_sx"]
    moved = ["_sy", *[f"_s_{c}" for c in payload]]

    def along(table: pa.Table, number: np.ndarray) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        sy = table["_sy"].to_numpy()  # not a number where null
        known = ~np.isnan(sy.astype(np.float64))
        sy = np.where(known, sy, 0).astype(np.int64)
        from_, near = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        ok = np.zeros(len(x), bool)
        sizes = [table[c].to_numpy().astype(np.int64) for c in ("h", "w")]
        for rows, nth, (h, w) in alike(number, sizes):
            lines, row = np.unique(nth * h + y[rows], return_inverse=True)
            shape = (len(lines), w)
            valid, at = np.zeros(shape, bool), np.full(shape, -1, np.int64)
            valid[row, x[rows]], at[row, x[rows]] = known[rows], rows
            unit = h * w + 1  # above any place of a cell, so that places only settle ties
            kind = np.int64 if unit * (h * h + w * w) < 1 << 61 else object
            offsets = np.zeros(shape, kind)
            gap = (y[rows] - sy[rows]).astype(kind)
            offsets[row, x[rows]] = gap * gap * unit + sy[rows].astype(kind) * w + x[rows]
            near[rows] = lower_envelope(offsets, valid, unit)[row, x[rows]]
            ok[rows] = near[rows] >= 0
            from_[rows] = np.where(ok[rows], at[row, near[rows]], 0)
        d2 = (x - near) ** 2 + (y - sy[from_]) ** 2
        take = pa.array(from_, mask=~ok)
        table = table.drop_columns(["_band"])
        for c in moved:
            table = table.set_column(table.column_names.index(c), c, table[c].take(take))
        return table.append_column("_d2", pa.array(d2, pa.int64(), mask=~ok)).append_column("_sx", pa.array(near.astype(np.int32), mask=~ok)).select(names)

    schema = StructType([*passed.drop("_band").schema.fields, *added])
    return over_groups(passed, ["image_id"] if single else ["image_id", "_band"], along, schema)


def fill_nearest(df: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """Replace values outside the mask by those of the nearest cell inside.

    Ties go to the smaller row, then column. A raster without a cell inside keeps its values.
    """
    found = nearest(df.drop(out) if out not in (value, mask) else df, F.col(mask), [value])
    filled = F.when(F.col(mask), F.col(value)).otherwise(F.when(F.col("_d2").isNotNull(), F.col(f"_s_{value}")).otherwise(F.col(value)))
    return found.withColumn(out, filled).drop("_d2", "_sy", "_sx", f"_s_{value}")


def edge_distance(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Euclidean distance to the nearest cell outside the mask; infinity where a raster has none."""
    found = nearest(df.drop(out) if out != mask else df, ~F.col(mask))
    return found.withColumn(out, F.coalesce(F.sqrt(F.col("_d2").cast("double")), F.lit(float("inf")))).drop("_d2", "_sy", "_sx")
