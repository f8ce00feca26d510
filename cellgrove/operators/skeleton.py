"""Thinning to one-cell lines, and the points read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.kernels import square
from cellgrove.operators.cells import position
from cellgrove.operators.components import TILE
from cellgrove.operators.neighbourhood import neighbourhood
from cellgrove.operators.tiles import one_tile, run
from cellgrove.session import cut

#: Margin around a tile. Each thinning sub-step reads one ring of neighbours,
#: so a pass may run this many of them before tiles must be exchanged again.
HALO = 16


def _ring(g: np.ndarray) -> np.ndarray:
    """The eight neighbours of every inner cell, clockwise from north."""
    n, m = g.shape[:2]
    around = ((0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0))
    return np.stack([g[a : n - 2 + a, b : m - 2 + b] for a, b in around])


def _thin_tile(g: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Zhang-Suen rounds on a padded grid; also what the last round removed."""
    removed = np.zeros_like(g)
    for _ in range(rounds):
        before = g.copy()
        for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            p = _ring(g)
            count = p.sum(0)
            rises = (~p & np.roll(p, -1, 0)).sum(0)
            go = (count >= 2) & (count <= 6) & (rises == 1)
            go &= ~p[list(first)].all(0) & ~p[list(second)].all(0)
            g[1:-1, 1:-1] &= ~go
        removed = before & ~g
        if not removed.any():
            break
    return g, removed


def thin(df: DataFrame, mask: str, out: str, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Centre lines of a mask by the parallel thinning of Zhang and Suen (1984).

    Mask cells go to every tile whose margin covers them; a tile runs as many
    rounds as its margin keeps exact and returns its own cells. Passes repeat
    until no tile's own cells changed in its last round, so a thick structure
    costs one shuffle per ``halo / 2`` rounds instead of two per round. Where the
    table's bound says that no raster reaches over a tile, each is thinned whole.
    """
    if one_tile(df, tile):

        def whole(b):
            values, known = b.layers[mask]
            on = known & (values > 0.5)
            g, gone = np.pad(on, [(1, 1), (1, 1), *[(0, 0)] * (on.ndim - 2)]), on
            while gone.any():
                g, gone = _thin_tile(g, halo // 2)
            return {out: (g[1:-1, 1:-1], np.ones(on.shape, bool))}

        return run(df, [mask], 0, whole, {out: mask}, tile)

    @F.pandas_udf("keep array<long>, busy boolean")
    def in_tile(ys: pd.Series, xs: pd.Series, ty: pd.Series, tx: pd.Series, w: pd.Series) -> pd.DataFrame:
        keep, busy = [], []
        for y, x, a, b, width in zip(ys, xs, ty, tx, w):
            y, x = np.asarray(y), np.asarray(x)
            y0, x0 = y.min() - 1, x.min() - 1
            g = np.zeros((np.ptp(y) + 3, np.ptp(x) + 3), bool)
            g[y - y0, x - x0] = True
            g, gone = _thin_tile(g, halo // 2)
            own = (y // tile == a) & (x // tile == b)
            left = own & g[y - y0, x - x0]
            keep.append(y[left].astype("int64") * width + x[left])
            busy.append(bool(gone[y - y0, x - x0][own].any()))
        return pd.DataFrame({"keep": keep, "busy": busy})

    def tiles(axis, size):
        first = F.greatest(F.floor((F.col(axis) - halo) / tile), F.lit(0))
        last = F.least(F.floor((F.col(axis) + halo) / tile), F.floor((F.col(size) - 1) / tile))
        return F.explode(F.sequence(first, last))

    alive = df.filter(F.col(mask)).select("image_id", "h", "w", "y", "x")
    while True:
        step = (
            alive.withColumn("ty", tiles("y", "h"))
            .withColumn("tx", tiles("x", "w"))
            .groupBy("image_id", "h", "w", "ty", "tx")
            .agg(F.collect_list("y").alias("ys"), F.collect_list("x").alias("xs"))
            .select("image_id", "h", "w", in_tile("ys", "xs", "ty", "tx", "w").alias("r"))
        )
        done = cut(step)
        alive = done.select("image_id", "h", "w", F.explode("r.keep").alias("pos")).select(
            "image_id", "h", "w", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x")
        )
        if done.filter("r.busy").isEmpty():
            break
    line = alive.select("image_id", "y", "x", F.lit(True).alias("_line"))
    return df.join(line, ["image_id", "y", "x"], "left").withColumn(out, F.coalesce("_line", F.lit(False))).drop("_line")


def line_points(df: DataFrame, skel: str, endpoints: str = "endpoint", branches: str = "branch") -> DataFrame:
    """Ends (2 line cells in the 3 x 3 window) and branch points (at least 5)."""
    window = [(a, b) for a, b in square(3)]
    counted = neighbourhood(df, window, {"_n": F.count_if(F.col(skel))}, "constant")
    return counted.withColumns(
        {endpoints: F.col(skel) & (F.col("_n") == 2), branches: F.col(skel) & (F.col("_n") >= 5)}
    ).drop("_n")


def reconnect(df: DataFrame, mask: str, fov: str, out: str, element, least: int) -> DataFrame:
    """Bridge small gaps: dilate, thin, drop short lines."""
    from cellgrove.operators.components import label, min_area
    from cellgrove.operators.morphology import dilate

    lines = thin(dilate(df, mask, element, "_grown"), "_grown", "_line")
    kept = min_area(label(lines, "_line", "_lc"), least, "_long", "_lc")
    return kept.withColumn(out, F.col("_long") & F.col(fov)).drop("_grown", "_line", "_lc", "_long")
