"""Thin edges, circles that they vote for, and the clean-up of what lies at a circle's centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators import components as P
from cellgrove.operators.cells import bound
from cellgrove.operators.filters import gradient
from cellgrove.operators.neighbourhood import correlate_many
from cellgrove.operators.threshold import hysteresis
from cellgrove.session import cut

AROUND = [(0, 1), (1, 1), (1, 0), (1, -1)]
#: Magnitudes this close are equal.
EVEN = 1e-12


def thin_edges(df: DataFrame, value: str, low: float, high: float, out: str = "edge", border: str = "replicate") -> DataFrame:
    """Ridges of the gradient's magnitude, ``_gx`` and ``_gy`` kept: hysteresis from ``low`` to ``high``.

    A cell is on a ridge if its magnitude is above that of one neighbour along the
    gradient, by the nearest of four directions, and not below that of the other.
    """
    steep = gradient(df, value, "_gx", "_gy", border).withColumn("_mag", F.hypot("_gx", "_gy"))
    shifts = {f"_m{i}{'ab'[s < 0]}": {(s * dy, s * dx): 1.0} for i, (dy, dx) in enumerate(AROUND) for s in (1, -1)}
    met = correlate_many(steep, "_mag", shifts, border)
    sector = F.pmod(F.bround(F.atan2("_gy", "_gx") * 4 / F.pi(), 0).cast("int"), F.lit(4))
    ridge = F.lit(False)
    for i in range(len(AROUND)):
        ahead, behind = F.col(f"_m{i}a"), F.col(f"_m{i}b")
        ridge = ridge | ((sector == i) & (F.col("_mag") > ahead + EVEN) & (F.col("_mag") >= behind - EVEN))
    marked = met.withColumns({"_wk": ridge & (F.col("_mag") >= low), "_st": ridge & (F.col("_mag") >= high)})
    return hysteresis(marked, "_st", "_wk", out).drop("_st", "_wk", "_mag", *shifts)


def circle_votes(edges: DataFrame, radii: list[int], edge: str = "edge", below: Column | None = None) -> DataFrame:
    """Votes for each (image, centre, radius), and ``score``, their share of the circle's length.

    An edge cell votes where the centre would be along its gradient, on either
    side, and for the eight cells around, since a gradient of a raster is that
    inexact. Votes are one hash aggregate, summed map-side. ``below`` limits the
    radii by an image's size.
    """
    sides = F.explode(F.array(F.lit(-1.0), F.lit(1.0)))
    rows = edges.filter(F.col(edge) & ((F.col("_gx") != 0) | (F.col("_gy") != 0)))
    rows = rows.withColumn("r", F.explode(F.array(*[F.lit(r) for r in radii])))
    rows = (rows if below is None else rows.filter(F.col("r") < below)).withColumn("_s", sides)
    size = F.hypot("_gx", "_gy")
    at = lambda c, g: F.bround(F.col(c) + F.col("_s") * F.col("r") * F.col(g) / size, 0).cast("int")
    exact = rows.select("image_id", "h", "w", "r", at("y", "_gy").alias("_cy"), at("x", "_gx").alias("_cx"))
    exact = exact.groupBy("image_id", "h", "w", "r", "_cy", "_cx").agg(F.count("*").alias("_n"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = exact.withColumn("_d", near).select(
        "image_id", "h", "w", "r", (F.col("_cy") + F.col("_d.a")).alias("cy"), (F.col("_cx") + F.col("_d.b")).alias("cx"), "_n"
    )
    inside = F.col("cy").between(0, F.col("h") - 1) & F.col("cx").between(0, F.col("w") - 1)
    votes = spread.filter(inside).groupBy("image_id", "h", "w", "r", "cy", "cx").agg(F.sum("_n").alias("votes"))
    return votes.withColumn("score", F.col("votes") / (2 * F.pi() * F.col("r")))


def circle_peaks(votes: DataFrame, n: int, apart: int = 8) -> DataFrame:
    """The ``n`` best circles of each image, ``rank`` from 1; one for each square of ``apart`` cells.

    Equal scores go to the larger radius, then to the upper and left centre.
    """
    better = F.struct("score", "r", (-F.col("cy")).alias("y"), (-F.col("cx")).alias("x"))
    square = [F.floor(F.col(c) / apart).alias(f"_{c}") for c in ("cy", "cx")]
    best = votes.groupBy("image_id", *square).agg(F.max(better).alias("b"))
    # a bounded number of ranks: first inside a strip of squares, then over the strips' best
    for keys in (["image_id", "_cy"], ["image_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("b"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return best.select("image_id", "rank", (-F.col("b.y")).alias("cy"), (-F.col("b.x")).alias("cx"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def drop_at_circles(
    df: DataFrame,
    mask: str,
    circles: DataFrame,
    out: str,
    half: int = 40,
    area: tuple[int, int] = (12, 1200),
    ratio: float = 4.0,
    reach: float = 30.0,
) -> DataFrame:
    """The mask without one blob an image: the compact component nearest to the best circle that has one.

    Components are those of the window of ``half`` cells around the centre. One
    counts if its area is in range, its axes differ by at most ``ratio`` and its
    centroid is within ``reach`` of the centre; equal distances go to the first in
    row order. Circles are tried by rank. Images without circles stay as they are.
    """
    cells = df.filter(mask).select("image_id", "y", "x").join(circles.select("image_id", "rank", "cy", "cx"), "image_id")
    window = F.col("y").between(F.col("cy") - half, F.col("cy") + half - 1) & F.col("x").between(F.col("cx") - half, F.col("cx") + half - 1)
    local = lambda c: (F.col(c) - F.col(f"c{c}") + half).cast("int").alias(c)
    held = cells.filter(window).select(
        F.struct("image_id", "rank", "cy", "cx").alias("image_id"),
        F.lit(2 * half).alias("h", metadata=bound(2 * half, 2 * half)),
        F.lit(2 * half).alias("w"),
        local("y"),
        local("x"),
        F.lit(True).alias("_m"),
    )
    labelled = cut(P.label(held, "_m", "_blob"))
    stats = P.component_stats(labelled, "_blob")
    axes = F.sqrt((F.col("eig_max") + 1e-6) / (F.abs("eig_min") + 1e-6))
    away = F.hypot(F.col("cx") - half, F.col("cy") - half)
    fits = stats.withColumn("_d", away).filter(F.col("area").between(*area) & (axes <= ratio) & (F.col("_d") <= reach))
    first = fits.groupBy(F.col("image_id.image_id").alias("_image")).agg(
        F.min(F.struct(F.col("image_id.rank").alias("k"), "_d", "_blob", F.col("image_id").alias("at"))).alias("t")
    )
    gone = labelled.join(first, (F.col("image_id") == F.col("t.at")) & (labelled["_blob"] == F.col("t._blob")))
    shift = lambda c: (F.col(c) - half + F.col(f"image_id.c{c}")).cast("int").alias(c)
    gone = gone.select(F.col("_image").alias("image_id"), shift("y"), shift("x"), F.lit(True).alias("_gone"))
    marked = df.join(gone, ["image_id", "y", "x"], "left")
    return marked.withColumn(out, F.col(mask) & F.col("_gone").isNull()).select(*[c for c in df.columns if c != out], out)
