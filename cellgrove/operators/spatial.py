"""Range joins between sparse points of a raster.

Points are put in square buckets as wide as the search distance; one side is
sent to the buckets around it, so a range join becomes an equi-join whose groups
are bounded by the bucket's cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucketed(df: DataFrame, y: str, x: str, size: int, around: bool) -> DataFrame:
    by, bx = F.floor(F.col(y) / size), F.floor(F.col(x) / size)
    if not around:
        return df.withColumns({"_by": by, "_bx": bx})
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_s", F.explode(shifts)).withColumns({"_by": by + F.col("_s.a"), "_bx": bx + F.col("_s.b")}).drop("_s")


def _near(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """Pairs within ``size`` along both axes; right columns are prefixed by ``r_``."""
    renamed = right.select("image_id", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "image_id"])
    met = _bucketed(left, "y", "x", size, False).join(
        _bucketed(renamed, "r_y", "r_x", size, True), ["image_id", "_by", "_bx"]
    )
    close = (F.abs(F.col("y") - F.col("r_y")) <= size) & (F.abs(F.col("x") - F.col("r_x")) <= size)
    return met.filter(close).drop("_by", "_bx")


def length(y: Column, x: Column) -> Column:
    """Root of the sum of squares. ``hypot`` may round it otherwise, and an order by scores that are equal on paper goes by the last bit."""
    return F.sqrt(y * y + x * x)


def distance() -> Column:
    return length((F.col("r_y") - F.col("y")).cast("double"), (F.col("r_x") - F.col("x")).cast("double"))


def outward_direction(endpoints: DataFrame, lines: DataFrame, radius: int = 7, k: int = 6) -> DataFrame:
    """Unit vector (``dy``, ``dx``) pointing away from the nearest line cells.

    ``endpoints`` and ``lines`` have ``image_id, y, x``. The mean of the k nearest
    line cells in the window gives the inward direction; without one, or with
    none left over, the direction is NULL.
    """
    near = _near(endpoints, lines.select("image_id", "y", "x"), radius).withColumn("_d", distance()).filter("_d > 0")
    order = Window.partitionBy("image_id", "y", "x").orderBy("_d", "r_y", "r_x")
    inner = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    mean = inner.groupBy("image_id", "y", "x").agg(
        (F.col("y") - F.avg("r_y")).alias("_vy"), (F.col("x") - F.avg("r_x")).alias("_vx")
    )
    norm = length(F.col("_vy"), F.col("_vx"))
    unit = mean.select(
        "image_id",
        "y",
        "x",
        F.when(norm > 1e-6, F.col("_vy") / norm).alias("dy"),
        F.when(norm > 1e-6, F.col("_vx") / norm).alias("dx"),
    )
    return endpoints.join(unit, ["image_id", "y", "x"], "left")


def pair_candidates(
    points: DataFrame,
    lo: float,
    hi: int,
    first_floor: float,
    second_floor: float,
    n: int | None = None,
    alignment_weight: float = 8.0,
) -> DataFrame:
    """Unordered pairs of endpoints of different components that face each other.

    ``points`` has ``image_id, y, x, comp, dy, dx``. The earlier point in reading
    order is the first. The score is the gap less the weighted poorer alignment;
    with ``n`` only the n lowest scores of each image are kept.
    """
    known = points.filter("dy is not null")
    met = _near(known, known, hi).filter("(y < r_y or (y = r_y and x < r_x)) and comp <> r_comp")
    gap = distance()
    # multiplied before the division, as in the SQL: the last bit ranks scores that are equal on paper
    ahead = lambda dy, dx: F.col(dy) * (F.col("r_y") - F.col("y")) / F.col("gap") + F.col(dx) * (F.col("r_x") - F.col("x")) / F.col("gap")
    scored = (
        met.withColumn("gap", gap)
        .filter((F.col("gap") >= lo) & (F.col("gap") <= hi))
        .withColumns(
            {
                "align_first": ahead("dy", "dx"),
                "align_second": -ahead("r_dy", "r_dx"),
            }
        )
        .filter((F.col("align_first") >= first_floor) & (F.col("align_second") >= second_floor))
        .withColumn("score", F.col("gap") - alignment_weight * F.least("align_first", "align_second"))
    )
    out = scored.select(
        "image_id",
        *[F.col(a).alias(b) for a, b in (("y", "y0"), ("x", "x0"), ("r_y", "y1"), ("r_x", "x1"))],
        "gap",
        "align_first",
        "align_second",
        "score",
    )
    if n is None:
        return out
    order = Window.partitionBy("image_id").orderBy("score", "y0", "x0", "y1", "x1")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def aligned_fragments(fragments: DataFrame, points: DataFrame, reach: int, floor: float = 0.35) -> DataFrame:
    """Components whose nearest cell to some endpoint is in reach and ahead of it.

    ``fragments`` has ``image_id, y, x, comp``; ``points`` as for pairs. A point's
    own component is no fragment of it. Returns distinct ``image_id, comp``.
    """
    near = F.struct("_d", "r_y", "r_x")
    nearest = (
        _near(points.filter("dy is not null"), fragments.select("image_id", "y", "x", "comp"), reach)
        .filter("comp <> r_comp")
        .withColumn("_d", distance())
        .groupBy("image_id", "y", "x", "dy", "dx", "r_comp")
        .agg(F.min(near).alias("_n"))
        .select("image_id", "y", "x", "dy", "dx", "r_comp", "_n.*")
    )
    span = F.greatest("_d", F.lit(1e-6))
    ahead = F.col("dy") * (F.col("r_y") - F.col("y")) / span + F.col("dx") * (F.col("r_x") - F.col("x")) / span
    return (
        nearest.filter((F.col("_d") <= reach) & (F.round(ahead, 9) >= floor))
        .select("image_id", F.col("r_comp").alias("comp"))
        .distinct()
    )
