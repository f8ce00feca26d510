"""Tile equalisation and co-occurrence features: histogram work on cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators.cells import GRID, KEY
from cellgrove.operators.neighbourhood import neighbourhood
from cellgrove.operators.quantiles import small_rasters
from cellgrove.operators.tiles import Layer, one_tile, run


def _equalised(layer: Layer, clip_limit: float, tiles: tuple[int, int], bins: int) -> Layer:
    """``clahe`` of a raster, or of a stack of them, that is held whole."""
    shape = layer[0].shape
    values, known = (v.reshape(*shape[:2], -1) for v in layer)
    (n, m, depth), (ty_n, tx_n) = values.shape, tiles
    th, tw = -(-n // ty_n), -(-m // tx_n)
    level = np.clip(np.where(known, values, 0), 0, bins - 1).astype(np.int64)

    def shown(size, tile, k):
        """Places of the padded axis that show a cell, and the cell."""
        place = np.arange(tile * k)
        cell = np.where(place < size, place, 2 * (size - 1) - place)
        return place[cell >= 0], cell[cell >= 0]

    (py, sy), (px, sx) = shown(n, th, ty_n), shown(m, tw, tx_n)
    group = ((py // th)[:, None, None] * tx_n + (px // tw)[None, :, None]) * depth + np.arange(depth)
    at = np.s_[sy[:, None], sx[None, :]]
    counts = np.bincount((group * bins + level[at])[known[at]], minlength=ty_n * tx_n * depth * bins).reshape(ty_n, tx_n, depth, bins)
    limit = max(math.floor(clip_limit * (th * tw) / bins), 1)
    over = np.maximum(counts - limit, 0).sum(-1, keepdims=True)
    share = over // bins
    rest = over - share * bins
    stride = np.maximum(bins // np.maximum(rest, 1), 1)
    bin_ = np.arange(bins)
    spread = share * (bin_ + 1) + np.minimum(rest, bin_ // stride + 1)
    lookup = np.minimum(np.rint((np.minimum(counts, limit).cumsum(-1) + spread) * ((bins - 1) / (th * tw))), bins - 1)

    def corners(size, tile, k):
        pos = np.arange(size) / tile - 0.5
        low = np.floor(pos)
        return [(np.clip(low + i, 0, k - 1).astype(np.int64), pos - low if i else 1 - (pos - low)) for i in (0, 1)]

    total = np.zeros(values.shape)
    for ty, fy in corners(n, th, ty_n):
        for tx, fx in corners(m, tw, tx_n):
            picked = lookup[ty[:, None, None], tx[None, :, None], np.arange(depth), level]
            total += (fy[:, None] * fx[None, :])[..., None] * picked
    return np.rint(np.round(total, 6)).reshape(shape), layer[1]


def clahe(df: DataFrame, value: str, clip_limit: float, tiles: tuple[int, int], out: str, bins: int = 256) -> DataFrame:
    """Contrast-limited equalisation per tile, blended bilinearly between tiles.

    ``value`` holds whole numbers 0..bins-1. Rasters that the tile grid does not
    divide are mirrored at the far edge. Histograms are combined map-side; only
    levels that occur or are asked for get a lookup row. Small rasters are equalised
    whole, many in a call. Cells without a value are left out.
    """
    if small_rasters(df) and one_tile(df):
        whole = lambda b: {out: _equalised(b.layers[value], clip_limit, tiles, bins)}
        return run(df, [value], 0, whole, {out: ""}).filter(F.col(out).isNotNull())
    ty_n, tx_n = tiles
    th, tw = F.ceil(F.col("h") / ty_n).cast("int"), F.ceil(F.col("w") / tx_n).cast("int")
    area = th * tw
    sized = df.withColumns({"_th": th, "_tw": tw, "_bin": F.col(value).cast("int")})

    def shown(axis, size, tile, n):
        """The position itself and, in the padding, its mirror image."""
        twin = 2 * (F.col(size) - 1) - F.col(axis)
        padded = (twin >= F.col(size)) & (twin < F.col(tile) * n)
        return F.when(padded, F.array(F.col(axis), twin)).otherwise(F.array(F.col(axis)))

    histogram = (
        sized.withColumn("_py", F.explode(shown("y", "h", "_th", ty_n)))
        .withColumn("_px", F.explode(shown("x", "w", "_tw", tx_n)))
        .select(
            "image_id",
            F.floor(F.col("_py") / F.col("_th")).cast("int").alias("ty"),
            F.floor(F.col("_px") / F.col("_tw")).cast("int").alias("tx"),
            F.col("_bin").alias("bin"),
            area.alias("area"),
            F.lit(1).cast("long").alias("c"),
        )
    )

    def corners(axis, tile, n):
        pos = F.col(axis) / F.col(tile) - 0.5
        low = F.floor(pos)
        frac = pos - low
        edge = lambda t: F.greatest(F.lit(0), F.least(t, F.lit(n - 1))).cast("int")
        return F.array(
            F.struct(edge(low).alias("t"), (1 - frac).alias("f")),
            F.struct(edge(low + 1).alias("t"), frac.alias("f")),
        )

    keep = [c for c in df.columns if c not in GRID]
    asked = (
        sized.withColumn("_corner_y", F.explode(corners("y", "_th", ty_n)))
        .withColumn("_corner_x", F.explode(corners("x", "_tw", tx_n)))
        .select(
            *GRID,
            *keep,
            F.col("_corner_y.t").alias("ty"),
            F.col("_corner_x.t").alias("tx"),
            F.col("_bin").alias("bin"),
            (F.col("_corner_y.f") * F.col("_corner_x.f")).alias("_f"),
            area.alias("area"),
        )
    )
    levels = histogram.unionByName(
        asked.select("image_id", "ty", "tx", "bin", "area", F.lit(0).cast("long").alias("c"))
    )
    tile = Window.partitionBy("image_id", "ty", "tx")
    limit = F.greatest(F.floor(F.lit(float(clip_limit)) * F.col("area") / bins), F.lit(1))
    counted = levels.groupBy("image_id", "ty", "tx", "bin", "area").agg(F.sum("c").alias("c"))
    counted = counted.withColumn("_over", F.sum(F.greatest(F.col("c") - limit, F.lit(0))).over(tile))
    share = F.floor(F.col("_over") / bins)
    rest = F.col("_over") - share * bins
    stride = F.greatest(F.floor(F.lit(float(bins)) / F.greatest(rest, F.lit(1))), F.lit(1))
    spread = share * (F.col("bin") + 1) + F.least(rest, F.floor(F.col("bin") / stride) + 1)
    kept = F.sum(F.least("c", limit)).over(tile.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    lookup = counted.select(
        "image_id",
        "ty",
        "tx",
        "bin",
        F.least(F.bround((kept + spread) * (float(bins - 1) / F.col("area")), 0), F.lit(float(bins - 1))).alias("_lut"),
    )
    return (
        asked.join(lookup, ["image_id", "ty", "tx", "bin"])
        .groupBy(*GRID)
        .agg(*[F.max(c).alias(c) for c in keep], F.bround(F.round(F.sum(F.col("_f") * F.col("_lut")), 6), 0).alias(out))
    )


PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")


def glcm(
    df: DataFrame, value: str, mask: str, distances=(1, 3, 5), angles=(0, 45, 90, 135), levels: int = 32
) -> DataFrame:
    """Grey-level co-occurrence features: mean and deviation over all offsets.

    Values 0..255 are quantised, masked-out cells count as level 0. One stencil
    brings each cell's partners together; pair counts combine map-side, and an
    image has at most offsets * levels^2 of them.
    """
    offsets = [
        (round(math.sin(math.radians(a)) * d), round(math.cos(math.radians(a)) * d)) for d in distances for a in angles
    ]
    level = F.when(
        F.col(mask), F.least(F.floor(F.col(value) / 256.0 * levels), F.lit(levels - 1)).cast("int")
    ).otherwise(0)
    quant = df.select(*GRID, level.alias("i"))
    at = lambda o: F.max(F.when((F.col("dy") == o[0]) & (F.col("dx") == o[1]), F.col("i")))
    met = neighbourhood(quant, offsets, {f"_j{k}": at(o) for k, o in enumerate(offsets)}, "constant")
    pairs = met.select(
        "image_id",
        "i",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_j{k}").alias("j")) for k in range(len(offsets))])).alias("p"),
    ).select("image_id", "i", "p.k", "p.j")
    counts = pairs.groupBy("image_id", "k", "i", "j").agg(F.count("j").alias("n"))
    # every image keeps all its offsets, also those longer than the raster
    both = counts.select(
        "image_id",
        "k",
        "n",
        F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("q"),
    ).select("image_id", "k", "n", "q.i", "q.j")
    total = both.groupBy("image_id", "k", "i", "j").agg(F.sum("n").alias("n"))
    gap = F.col("i") - F.col("j")
    per_offset = total.groupBy("image_id", "k").agg(
        F.sum("n").alias("t"),
        *[
            F.sum(e * F.col("n")).alias(n)
            for n, e in (
                ("c", gap * gap),
                ("d", F.abs(gap)),
                ("h", 1.0 / (1.0 + gap * gap)),
                ("s1", F.col("i")),
                ("s2", F.col("i") * F.col("i")),
                ("sx", F.col("i") * F.col("j")),
            )
        ],
        F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    t = F.greatest("t", F.lit(1))
    mean = F.col("s1") / t
    var = F.col("s2") / t - mean * mean
    asm = F.col("n2") / (t * t)
    rated = per_offset.select(
        "image_id",
        (F.coalesce("c", F.lit(0)) / t).alias("contrast"),
        (F.coalesce("d", F.lit(0)) / t).alias("dissimilarity"),
        (F.coalesce("h", F.lit(0.0)) / t).alias("homogeneity"),
        F.sqrt(asm).alias("energy"),
        F.when(var > 1e-15, (F.col("sx") / t - mean * mean) / var).otherwise(1.0).alias("correlation"),
        asm.alias("ASM"),
    )
    return rated.groupBy("image_id").agg(
        *[F.avg(p).alias(f"glcm_{p}_mean") for p in PROPERTIES],
        *[F.stddev_pop(p).alias(f"glcm_{p}_std") for p in PROPERTIES],
    )
