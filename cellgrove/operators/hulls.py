"""Convex hulls of components, from the ends of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chain(points: Column) -> Column:
    """The convex lower chain of points (u, v) in order of u, by one fold.

    A new point goes on the end of a chain of rising slopes. The chain's points that
    it makes needless are always the last ones, so what stays is those where
    the turn towards it is still a left one.
    """
    start = F.array().cast("array<struct<u:bigint,v:bigint>>")

    def add(chain: Column, p: Column) -> Column:
        def stays(q: Column, k: Column) -> Column:
            before = F.get(chain, k - 1)
            turn = (q["u"] - before["u"]) * (p["v"] - before["v"]) - (q["v"] - before["v"]) * (p["u"] - before["u"])
            return (k == 0) | (turn > 0)

        return F.concat(F.filter(chain, stays), F.array(p))

    return F.aggregate(points, start, add)


def _twice_below(chain: Column) -> Column:
    """Twice the signed area between a chain and the axis v = 0."""
    part = F.transform(chain, lambda p, k: F.when(k > 0, (F.get(chain, k - 1)["v"] + p["v"]) * (p["u"] - F.get(chain, k - 1)["u"])).otherwise(0))
    return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)


def hull_areas(df: DataFrame, comp: str, out: str = "hull_area") -> DataFrame:
    """Per (image_id, ``comp``): area of the convex hull of the cells' centres.

    Each row of a component adds its two ends only, counted map-side; a component's
    hull is folded from at most one entry for each raster row. Components on one line have area 0.
    """
    rows = df.filter(F.col(comp).isNotNull()).groupBy("image_id", comp, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    side = lambda v: F.struct(F.col("y").cast("long").alias("u"), v.cast("long").alias("v"))
    ends = rows.groupBy("image_id", comp).agg(F.array_sort(F.collect_list(side(F.col("lo")))).alias("_l"), F.array_sort(F.collect_list(side(-F.col("hi")))).alias("_r"))
    chains = ends.select("image_id", comp, _chain(F.col("_l")).alias("_l"), _chain(F.col("_r")).alias("_r"))
    # the right side was mirrored, so both areas are counted below their chains
    return chains.select("image_id", comp, (-(_twice_below(F.col("_l")) + _twice_below(F.col("_r"))) / 2.0).alias(out))
