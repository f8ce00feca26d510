"""Border bands, edge ramps and rim masks over a distance-to-edge column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.colour import clip
from cellgrove.operators.cells import join_stats
from cellgrove.operators.distance import edge_distance


def border_band(distance: str, mask: str, thickness: float) -> Column:
    """Mask cells within ``thickness`` of the outside."""
    return F.col(mask) & (F.col(distance) <= thickness)


def inner(distance: str, mask: str, radius: float | Column) -> Column:
    """Mask cells farther than ``radius`` from the outside."""
    return F.col(mask) & (F.col(distance) > radius)


def edge_weight(distance: str, mask: str, zero: float, ramp: float) -> Column:
    """0 up to ``zero`` from the outside, rising to 1 over ``ramp``."""
    rise = F.when(F.col(distance) < float("inf"), clip((F.col(distance) - zero) / max(1.0, ramp))).otherwise(1.0)
    return F.when(F.col(mask), rise).otherwise(0.0)


def side_rule(share: float, least: int, most: int) -> Column:
    """A length proportional to the raster's shorter side, rounded and clipped."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.least("h", "w") * F.lit(share), 0))).cast("int")


def shrink_mask(df: DataFrame, mask: str, out: str, attempts: list[tuple[Column, float | None]]) -> DataFrame:
    """The mask without its rim, as deep as it can be without losing too much of it.

    ``attempts`` are (radius, share) in order: the first one whose cells farther
    than the radius from the outside number at least that share of the mask's
    (whole cells, rounded down) is taken; a share of None asks for any cell at
    all. Where none does, the mask stays as it is. Radii are fixed for an image.
    """
    held = edge_distance(df, mask, "_edge")
    left = [F.count_if(inner("_edge", mask, radius)).alias(f"_n{i}") for i, (radius, _) in enumerate(attempts)]
    counts = held.groupBy("image_id").agg(F.count_if(mask).alias("_all"), *left)
    taken = F.lit(None).cast("int")
    for i, (_, share) in reversed(list(enumerate(attempts))):
        least = F.lit(1) if share is None else F.floor(F.col("_all") * F.lit(share))
        taken = F.when(F.col(f"_n{i}") >= least, i).otherwise(taken)
    depth = F.lit(0.0)
    for i, (radius, _) in enumerate(attempts):
        depth = F.when(F.col("_taken") == i, radius.cast("double")).otherwise(depth)
    chosen = join_stats(held, counts.select("image_id", taken.alias("_taken")))
    return chosen.withColumn(out, F.col(mask) & (F.col("_taken").isNull() | (F.col("_edge") > depth))).drop("_edge", "_taken")


def _halved(radius: Column) -> Column:
    return F.greatest(F.lit(3), F.bround(radius * 0.5, 0).cast("int"))


def suppress_border(df: DataFrame, mask: str, out: str, radius: Column | None = None) -> DataFrame:
    """Shrink by a share of the shorter side, by half of that where too little would be left."""
    # fixed values: share of the side, least and most radius, share of the mask that must be left
    radius = side_rule(0.075, 18, 60) if radius is None else radius
    return shrink_mask(df, mask, out, [(radius, 0.42), (_halved(radius), None)])


def exclude_outer_line(df: DataFrame, mask: str, out: str, radius: Column | None = None) -> DataFrame:
    """A narrower rim than ``suppress_border``'s, which follows with half the radius where too little would be left."""
    # fixed values, as above
    radius = side_rule(0.055, 16, 48) if radius is None else radius
    half = F.greatest(F.lit(3), F.floor(radius / 2).cast("int"))
    return shrink_mask(df, mask, out, [(radius, 0.55), (half, 0.42), (_halved(half), None)])


def outer_band(df: DataFrame, mask: str, out: str, radius: Column | None = None) -> DataFrame:
    """Mask cells within a share of the shorter side from the outside."""
    radius = side_rule(0.105, 28, 90) if radius is None else radius
    held = edge_distance(df, mask, "_edge")
    return held.withColumn(out, F.col(mask) & (F.col("_edge") <= radius)).drop("_edge")
