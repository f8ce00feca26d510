"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.session import cut


def connected_components(edges: DataFrame, a: str, b: str, scope: list[str] = ()) -> DataFrame:
    """Smallest reachable node for every node: columns ``scope``, ``node``, ``root``.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every
    node tells its larger, then its smaller neighbours about the smallest one it
    knows. Minima are combined map-side and a hub's edges are only ever joined
    to one row, so skew splitting applies; rounds grow with the logarithm of the
    component size. The edge table is written out each round.
    """
    scope = list(scope)
    e = edges.select(*scope, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    e = cut(e.distinct())
    before = None
    while True:
        state = e.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64(*scope, "u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or state["n"] == 0:
            break
        before = state
        e = cut(_small_star(_large_star(e, scope), scope))
    roots = e.select(*scope, F.col("u").alias("node"), F.col("v").alias("root"))
    own = e.select(*scope, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)


def _large_star(e: DataFrame, scope: list[str]) -> DataFrame:
    both = e.unionByName(e.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*scope, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u").join(least, [*scope, "u"]).select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u > v")
        .distinct()
    )


def _small_star(e: DataFrame, scope: list[str]) -> DataFrame:
    least = e.groupBy(*scope, "u").agg(F.min("v").alias("m"))
    moved = e.join(least, [*scope, "u"]).filter("v > m").select(*scope, F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select(*scope, "u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()
