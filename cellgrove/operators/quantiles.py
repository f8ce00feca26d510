"""Exact per-group percentiles that survive one group holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups up to this many rows are summarised by Spark's own ``percentile``,
#: whose state is a map of the group's distinct values. Larger groups take the
#: bracketed path below, whose state does not grow with the group.
PLAIN_GROUP_ROWS = 1 << 22
_SKETCH_ACCURACY = 10_000
#: Metadata key on column ``h``: the largest raster of the table, in cells.
MAX_CELLS = "max_cells"
#: The same for the longer side of the largest raster.
MAX_SIDE = "max_side"
#: Rasters known to have no more cells than this get their statistics from windows over the image.
WINDOW_CELLS = 1 << 12

Spec = tuple[Column, float]


def group_stats(
    df: DataFrame,
    by: list[str],
    percentiles: dict[str, Spec],
    aggs: dict[str, Column] | None = None,
    size: str | None = None,
    plain_rows: int = PLAIN_GROUP_ROWS,
) -> DataFrame:
    """One row per group with linear-interpolation percentiles and other aggregates.

    ``percentiles`` maps an output name to ``(value, p)``; NULL values are left
    out, so a mask is written as ``F.when(mask, value)``. ``size`` is an
    expression known to bound the group's row count (for rasters ``h * w``).
    Cell tables whose source knows its largest raster say so in the metadata of
    ``h``; then one branch suffices. Without ``size`` every group takes the
    bracketed path.
    """
    aggs = aggs or {}
    plain_cols = [a.alias(n) for n, a in aggs.items()] + [
        F.percentile(v, F.lit(float(p))).alias(n) for n, (v, p) in percentiles.items()
    ]
    bound = df.schema["h"].metadata.get(MAX_CELLS) if size and "h" in df.columns else None
    if not percentiles or (bound is not None and bound <= plain_rows):
        return df.groupBy(*by).agg(*plain_cols)
    if size is None:
        return _bracketed(df, by, percentiles, aggs)
    small = df.filter(F.expr(size) <= plain_rows).groupBy(*by).agg(*plain_cols)
    large = _bracketed(df.filter(F.expr(size) > plain_rows), by, percentiles, aggs)
    return small.unionByName(large)


def small_rasters(df: DataFrame) -> bool:
    """Whether the table's bound says that a window may hold any of its rasters."""
    bound = df.schema["h"].metadata.get(MAX_CELLS) if "h" in df.columns else None
    return bound is not None and bound <= WINDOW_CELLS


def window_stats(df: DataFrame, percentiles: dict[str, Spec], aggs: dict[str, Column]) -> DataFrame:
    """``df`` with the statistics of each image as columns, for small rasters.

    Percentiles of one value (the same column object) share one count of its values.
    """
    image = Window.partitionBy("image_id")
    cols, picked = {n: a.over(image) for n, a in aggs.items()}, {}
    of_value: dict[int, list[str]] = {}
    for n, (v, _) in percentiles.items():
        of_value.setdefault(id(v), []).append(n)
    for i, names in enumerate(of_value.values()):
        shares = F.array(*[F.lit(float(percentiles[n][1])) for n in names])
        cols[f"_qs{i}"] = F.percentile(percentiles[names[0]][0], shares).over(image)
        picked |= {n: F.col(f"_qs{i}")[k] for k, n in enumerate(names)}
    at = df.withColumns(cols) if cols else df
    return at.withColumns(picked).drop(*[f"_qs{i}" for i in range(len(of_value))]) if picked else at


def _bracketed(df, by, percentiles, aggs):
    """Sketch, bracket, count: exact percentiles in bounded state.

    A quantile sketch (combined map-side, bounded size) gives two cut points
    around each wanted rank. Values are counted per (group, bucket, value), so
    the shuffle key contains the value and a dominant group spreads over all
    tasks. Only the buckets that hold a wanted rank are then sorted.
    """
    names = list(percentiles)
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("m"), percentiles[n][0].cast("double").alias("v"))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("_e"),
    ).select(*by, F.col("_e.m").alias("m"), F.col("_e.v").alias("v")).filter("v is not null")

    eps = 2.0 / _SKETCH_ACCURACY
    key = [*by, "m"]
    wanted = F.create_map(
        *[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(float(percentiles[n][1])))]
    )
    # one sketch per measure with both cut points of its own rank
    sketches = long.groupBy(*key).agg(
        F.count("*").alias("n"),
        *[
            F.percentile_approx(
                F.when(F.col("m") == i, F.col("v")),
                [max(0.0, percentiles[n][1] - eps), min(1.0, percentiles[n][1] + eps)],
                _SKETCH_ACCURACY,
            ).alias(f"c{i}")
            for i, n in enumerate(names)
        ],
    ).select(*key, "n", F.coalesce(*[F.col(f"c{i}") for i in range(len(names))]).alias("cuts"))

    bucketed = long.join(sketches, key).select(
        *key,
        ((F.col("v") >= F.col("cuts")[0]).cast("int") + (F.col("v") > F.col("cuts")[1]).cast("int")).alias("b"),
        "v",
        "n",
    )
    counted = bucketed.groupBy(*key, "b", "v", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rank = wanted[F.col("m")] * (F.col("n") - 1)
    buckets = (
        counted.groupBy(*key, "b", "n").agg(F.sum("c").alias("bc"))
        .withColumn("off", F.coalesce(F.sum("bc").over(before), F.lit(0)))
        .withColumn("lo", F.floor(rank))
        .withColumn("hi", F.ceil(rank))
        .withColumn("frac", rank - F.floor(rank))
        .filter((F.col("off") <= F.col("hi")) & (F.col("off") + F.col("bc") > F.col("lo")))
    )
    running = Window.partitionBy(*key, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counted.join(buckets.drop("n"), [*key, "b"])
        .withColumn("end", F.col("off") + F.sum("c").over(running))
        .withColumn("start", F.col("end") - F.col("c"))
    )
    values = picked.groupBy(*key).agg(
        F.max(F.when((F.col("start") <= F.col("lo")) & (F.col("lo") < F.col("end")), F.col("v"))).alias("vlo"),
        F.max(F.when((F.col("start") <= F.col("hi")) & (F.col("hi") < F.col("end")), F.col("v"))).alias("vhi"),
        F.max("frac").alias("frac"),
    ).withColumn("q", F.col("vlo") * (1 - F.col("frac")) + F.col("vhi") * F.col("frac"))
    wide = values.groupBy(*by).agg(
        *[F.max(F.when(F.col("m") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    )
    base = df.groupBy(*by).agg(*([a.alias(n) for n, a in aggs.items()] or [F.count("*").alias("_rows")]))
    return base.join(wide, by, "left").select(*by, *aggs, *names)
