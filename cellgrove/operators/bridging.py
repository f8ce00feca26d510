"""Bridges over gaps between line ends: one-to-one pairs, and the cells on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import components as P
from cellgrove.operators.cells import KEY, join_stats
from cellgrove.operators.masked import active_percentiles
from cellgrove.operators.skeleton import line_points, thin
from cellgrove.operators.spatial import outward_direction, pair_candidates
from cellgrove.session import cut, shared

ENDS = ["y0", "x0", "y1", "x1"]


def greedy_pairs(pairs: DataFrame, by: list[str] = ("image_id",)) -> DataFrame:
    """The pairs that a run through all of them by score takes, each point once.

    ``pairs`` has ``by``, y0, x0, y1, x1 and score; equal scores go by the points. A pair
    that comes first at both its points is taken by such a run whatever lies elsewhere,
    so all of these are taken at once, the pairs that touch them go, and the rest is
    looked at again: the same result in few rounds, without an order over an image.
    """
    by = list(by)
    order = F.struct("score", *ENDS).alias("pair")
    points = F.explode(F.array(F.struct(F.col("pair.y0").alias("y"), F.col("pair.x0").alias("x")), F.struct(F.col("pair.y1").alias("y"), F.col("pair.x1").alias("x")))).alias("at")
    left, taken = cut(pairs.select(*by, order).distinct()), []
    while not left.isEmpty():
        best = left.select(*by, "pair", points).groupBy(*by, "at").agg(F.min("pair").alias("pair"))
        won = cut(best.groupBy(*by, "pair").agg(F.count("*").alias("n")).filter("n = 2").drop("n"))
        taken.append(won)
        used = won.select(*by, points)
        for y, x in (("y0", "x0"), ("y1", "x1")):
            one = used.select(*by, F.col("at.y").alias("_y"), F.col("at.x").alias("_x"))
            on = [F.col("pair")[y] == F.col("_y"), F.col("pair")[x] == F.col("_x")]
            left = left.alias("l").join(one.alias("u"), [*[F.col(f"l.{c}") == F.col(f"u.{c}") for c in by], *on], "left_anti")
        left = cut(left)
    found = taken[0] if taken else left
    for more in taken[1:]:
        found = found.unionByName(more)
    return found.select(*by, "pair.*")


def line_cells(pairs: DataFrame) -> DataFrame:
    """Each pair with the cells of the straight line between its points, one a step of the longer axis."""
    dy, dx = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    steps = F.greatest(F.abs(dy), F.abs(dx), F.lit(1))
    at = lambda start, d: (F.col(start) + F.floor((2 * F.col("_i") * d + F.col("_n")) / (2 * F.col("_n")))).cast("int")
    each = pairs.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    return each.withColumns({"y": at("y0", dy), "x": at("x0", dx)}).drop("_i", "_n")


def scored_bridges(
    points: DataFrame, cells: DataFrame, mask: str, response: str, support: str, fov: str,
    least: float = 3.0, max_gap: int = 13, floors: tuple[float, float] = (0.38, 0.30), align: tuple[float, float] = (0.45, 0.25),
) -> DataFrame:
    """Pairs of facing ends whose gap shows some response or support: image_id, y0, x0, y1, x1, score.

    Means are taken over the line's cells in the field of view and outside the
    mask; a pair without such a cell, or with both means below the image's
    active percentiles, is left out. The lower the score, the better.
    """
    near = pair_candidates(points, least, max_gap, *align, alignment_weight=2.0)
    rest = cells.select(*KEY, mask, response, support, fov)
    gaps = line_cells(near).join(rest, KEY).filter(F.col(fov) & ~F.col(mask))
    means = gaps.groupBy("image_id", *ENDS).agg(F.first("score").alias("_s"), F.avg(response).alias("_r"), F.avg(support).alias("_p"))
    low = active_percentiles(cells, {"_fr": (response, floors[0]), "_fp": (support, floors[1])}, fov)
    kept = join_stats(means, low).filter((F.col("_r") >= F.col("_fr")) | (F.col("_p") >= F.col("_fp")))
    return kept.select("image_id", *ENDS, (F.col("_s") - F.col("_r") - F.col("_p")).alias("score"))


def connect_ends(df: DataFrame, mask: str, response: str, support: str, fov: str, out: str, max_gap: int = 13) -> DataFrame:
    """The mask with straight bridges between line ends of different components that face each other."""
    df = shared(df)
    lined = line_points(thin(P.label(df, mask, "_comp"), mask, "_sk"), "_sk", "_end", "_branch")
    lined = cut(lined.select(*KEY, "_comp", "_sk", "_end").filter("_sk"))
    ends = lined.filter("_end").select(*KEY, F.col("_comp").alias("comp"))
    points = cut(outward_direction(ends, lined))
    chosen = greedy_pairs(scored_bridges(points, df, mask, response, support, fov, max_gap=max_gap))
    bridge = line_cells(chosen).select(*KEY).distinct().withColumn("_bridge", F.lit(True))
    joined = df.join(bridge, KEY, "left")
    return joined.withColumn(out, F.col(fov) & (F.col(mask) | F.coalesce("_bridge", F.lit(False)))).drop("_bridge")
