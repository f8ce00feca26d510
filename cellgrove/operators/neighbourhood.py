"""Windows: linear filters on tiles, and any other aggregate as one scatter and one hash aggregate.

In ``neighbourhood`` every cell is sent to the targets whose window covers it, and the contributions
are summed per target. Spark combines them before the shuffle, so what travels
is about one row per cell, not one per kernel tap, and the key (image, y, x)
spreads even a single huge raster over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.cells import GRID
from cellgrove.operators.tiles import BORDERS, run


def _images(axis: str, size: str, r: int, border: str) -> Column:
    """Padded positions along one axis that show this cell."""
    if border == "constant" or r == 0:
        return F.array(F.col(axis))
    if border == "replicate":
        sql = (
            f"concat(array({axis}),"
            f" if({axis} = 0, sequence(-{r}, -1), cast(array() as array<int>)),"
            f" if({axis} = {size} - 1, sequence({size}, {size} + {r - 1}), cast(array() as array<int>)))"
        )
        return F.expr(sql)
    if border == "reflect":
        period, twin = f"(2 * {size})", f"(-1 - {axis})"
    elif border == "reflect101":
        period, twin = f"greatest(2 * {size} - 2, 1)", f"(-{axis})"
    else:
        raise ValueError(border)
    turns = f"sequence(-cast({r} div {period} as int) - 1, cast({r} div {period} as int) + 1)"
    sql = (
        f"array_distinct(filter(flatten(transform({turns}, m -> "
        f"array({axis} + m * {period}, {twin} + m * {period}))), u -> u between -{r} and {size} - 1 + {r}))"
    )
    # cells away from the edge show up once only
    margin = r if border == "reflect" else r + 1
    return F.expr(f"if({axis} >= {margin} and {axis} < {size} - {margin}, array({axis}), {sql})")


def neighbourhood(
    df: DataFrame,
    taps: list[tuple],
    aggs: dict[str, Column],
    border: str,
    weights: tuple[str, ...] = (),
) -> DataFrame:
    """Aggregate, for every cell, over the cells under a window.

    ``taps`` is a list of ``(dy, dx, *weights)``; a target cell t reads the cell
    at ``t + (dy, dx)``. ``aggs`` are aggregate expressions over the source
    columns, the named ``weights``, ``dy``/``dx`` and ``is_centre``. All other
    columns of ``df`` are carried through the same aggregate. The centre always
    takes part; windows without it give it zero weight or test ``dy``/``dx``.
    """
    if border not in BORDERS:
        raise ValueError(border)
    if not any(t[0] == 0 and t[1] == 0 for t in taps):
        taps = [(0, 0, *([0.0] * len(weights))), *taps]
    ry = max(abs(t[0]) for t in taps)
    rx = max(abs(t[1]) for t in taps)
    literal = ", ".join(
        "named_struct('dy', {}, 'dx', {}{})".format(
            int(t[0]), int(t[1]), "".join(f", '{n}', {float(v)!r}D" for n, v in zip(weights, t[2:]))
        )
        for t in taps
    )
    src = df
    if border == "constant":
        src = src.withColumns({"_uy": F.col("y"), "_ux": F.col("x")})
    else:
        src = src.withColumn("_uy", F.explode(_images("y", "h", ry, border)))
        src = src.withColumn("_ux", F.explode(_images("x", "w", rx, border)))
    hit = src.withColumn("_tap", F.explode(F.expr(f"array({literal})")))
    keep = [c for c in df.columns if c not in GRID]
    hit = hit.select(
        "image_id",
        "h",
        "w",
        (F.col("_uy") - F.col("_tap.dy")).alias("_ty"),
        (F.col("_ux") - F.col("_tap.dx")).alias("_tx"),
        F.col("_tap.dy").alias("dy"),
        F.col("_tap.dx").alias("dx"),
        *[F.col(f"_tap.{n}").alias(n) for n in weights],
        (
            (F.col("_tap.dy") == 0)
            & (F.col("_tap.dx") == 0)
            & (F.col("_uy") == F.col("y"))
            & (F.col("_ux") == F.col("x"))
        ).alias("is_centre"),
        *keep,
    ).filter("_ty >= 0 and _ty < h and _tx >= 0 and _tx < w")
    carried = [c for c in keep if c not in aggs]
    return (
        hit.groupBy("image_id", "h", "w", F.col("_ty").alias("y"), F.col("_tx").alias("x"))
        .agg(
            F.max(F.when(F.col("is_centre"), F.lit(1))).alias("_here"),
            *[F.max(F.when(F.col("is_centre"), F.col(c))).alias(c) for c in carried],
            *[a.alias(n) for n, a in aggs.items()],
        )
        .filter("_here = 1")
        .select(*GRID, *carried, *aggs)
    )


def correlate_many(df: DataFrame, value: str, kernels: dict[str, dict], border: str) -> DataFrame:
    """Correlate one column with several kernels ``{(dy, dx): weight}`` in a single pass over tiles."""
    reach = max(max(abs(a), abs(b)) for kernel in kernels.values() for a, b in kernel)
    weights = list(kernels.values())
    chain = lambda b: dict(zip(kernels, b.correlate(b.layers[value], weights, border)))
    return run(df, [value], reach, chain, dict.fromkeys(kernels, ""))


def correlate(df: DataFrame, value: str, kernel: dict, border: str, out: str) -> DataFrame:
    return correlate_many(df, value, {out: kernel}, border)


def separable_many(df: DataFrame, specs: dict[str, tuple[str, dict[int, float]]], border: str) -> DataFrame:
    """Several separable filters, out -> (column, 1-D kernel), in one pass altogether: 2k taps instead of k squared."""
    reach = max(abs(d) for _, line in specs.values() for d in line)
    chain = lambda b: {o: b.separable(b.layers[c], line, border) for o, (c, line) in specs.items()}
    return run(df, sorted({c for c, _ in specs.values()}), reach, chain, dict.fromkeys(specs, ""))


def separable(df: DataFrame, value: str, taps: dict[int, float], border: str, out: str) -> DataFrame:
    return separable_many(df, {out: (value, taps)}, border)
