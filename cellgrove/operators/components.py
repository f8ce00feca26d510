"""Connected components of masks, their statistics and the rules that keep or drop them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators.cells import KEY, position, settled
from cellgrove.operators.graph import connected_components
from cellgrove.operators.neighbourhood import neighbourhood
from cellgrove.operators.quantiles import small_rasters
from cellgrove.operators.tiles import one_tile, run
from cellgrove.session import cut

#: Side of the square a raster is divided into for local work.
TILE = 128

_FORWARD = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, -1), (1, 0), (1, 1)]}


def _local_labels(pos: np.ndarray, width: int, conn: int) -> np.ndarray:
    """Lowest linked position for each position of one tile."""
    order = np.argsort(pos)
    y, x = np.divmod(pos[order], width)
    grid = np.full((np.ptp(y) + 3, np.ptp(x) + 3), -1)
    y, x = y - y.min() + 1, x - x.min() + 1
    node = np.arange(len(pos))
    grid[y, x] = node
    ends = [grid[y + dy, x + dx] for dy, dx in _FORWARD[conn]]
    out = np.empty_like(pos)
    out[order] = pos[order][_lowest(node, ends)]
    return out


def _lowest(node: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """Lowest linked node of each; ``ends`` are the nodes' neighbours by direction, -1 for none."""
    a = np.concatenate([node[e >= 0] for e in ends])
    b = np.concatenate([e[e >= 0] for e in ends])
    low = node
    while True:
        best = np.minimum(low[a], low[b])
        nxt = low.copy()
        for side in (low[a], low[b], a, b):
            np.minimum.at(nxt, side, best)
        nxt = nxt[nxt]
        if np.array_equal(nxt, low):
            return low
        low = nxt


def _stack_labels(on: np.ndarray, conn: int) -> np.ndarray:
    """Lowest linked row-major position for each cell of a raster, or of a stack of them, where ``on`` holds."""
    on = on.reshape(*on.shape[:2], -1)
    n, m, _ = on.shape
    node = np.arange(np.count_nonzero(on))
    grid = np.full((n + 2, m + 2, on.shape[2]), -1)
    grid[1:-1, 1:-1][on] = node
    ends = [grid[1 + dy : n + 1 + dy, 1 + dx : m + 1 + dx][on] for dy, dx in _FORWARD[conn]]
    y, x, _ = np.nonzero(on)
    out = np.zeros(on.shape)
    out[on] = (y * m + x)[_lowest(node, ends)]
    return out


def label(df: DataFrame, mask: str, out: str = "comp", conn: int = 8, tile: int = TILE) -> DataFrame:
    """Label the mask's components by their lowest row-major position; NULL outside.

    Each tile, a group of bounded size, is labelled on its own in one Arrow
    batch. Only cells facing a tile border can link two tiles: their links form
    a graph of tile components, far smaller than the raster, which is closed by
    iterative star contraction. Rasters of one tile add nothing to the graph; where
    the table's bound says that all are such, each is labelled whole, many in a call.
    """
    if one_tile(df, tile):

        def whole(b):
            values, known = b.layers[mask]
            on = known & (values > 0.5)
            return {out: (_stack_labels(on, conn).reshape(on.shape), on)}

        return run(df, [mask], 0, whole, {out: ""}, tile).withColumn(out, F.col(out).cast("long"))

    @F.pandas_udf("array<long>")
    def in_tile(pos: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([_local_labels(np.asarray(p), int(w), conn) for p, w in zip(pos, width)])

    pos = position()
    tiled = (
        df.filter(F.col(mask))
        .select("image_id", "h", "w", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"), pos.alias("pos"))
        .groupBy("image_id", "h", "w", "ty", "tx")
        .agg(F.collect_list("pos").alias("pos"))
    )
    zipped = F.explode(F.arrays_zip("pos", in_tile("pos", "w").alias("low")))
    local = cut(tiled.select("image_id", "h", "w", "ty", "tx", zipped.alias("z")).select(
        "image_id", "h", "w", "ty", "tx", F.col("z.pos").alias("pos"), F.col("z.low").alias("low")
    ))
    roots = connected_components(_seams(local, conn, tile), "a", "b", ["image_id"]).withColumnRenamed("node", "low")
    named = local.join(roots, ["image_id", "low"], "left").select(
        "image_id", "pos", F.coalesce("root", "low").alias(out)
    )
    return df.withColumn("pos", pos).join(named, ["image_id", "pos"], "left").drop("pos")


def _seams(local: DataFrame, conn: int, tile: int) -> DataFrame:
    """Pairs of tile components that touch across a tile border."""
    y, x = F.floor(F.col("pos") / F.col("w")), F.col("pos") % F.col("w")
    at_edge = (y % tile).isin(0, tile - 1) | (x % tile).isin(0, tile - 1)
    rim = local.filter(((F.col("h") > tile) | (F.col("w") > tile)) & at_edge).withColumns({"y": y, "x": x})
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in _FORWARD[conn]])
    ny, nx = F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")
    outward = (
        rim.withColumn("s", F.explode(steps))
        .withColumns({"ny": ny, "nx": nx})
        .filter("nx >= 0 and nx < w")
        .filter((F.floor(F.col("ny") / tile) != F.col("ty")) | (F.floor(F.col("nx") / tile) != F.col("tx")))
        .select("image_id", F.col("low").alias("a"), (F.col("ny") * F.col("w") + F.col("nx")).alias("pos"))
    )
    return outward.join(rim.select("image_id", "pos", F.col("low").alias("b")), ["image_id", "pos"]).select(
        "image_id", "a", "b"
    ).distinct()


def component_stats(
    df: DataFrame, comp: str = "comp", values: tuple[str, ...] = (), counts: tuple[str, ...] = (), extra: dict | None = None
) -> DataFrame:
    """One row per component: area, box, centroid, covariance, eigenvalues, value summaries.

    Everything is algebraic, so a component with most of the cells is combined
    map-side. ``values`` get mean and max, boolean ``counts`` get totals.
    """
    sums = _sums(values, counts) | {n: (lambda over, a=a: over(a)) for n, a in (extra or {}).items()}
    plain = lambda a: a
    grouped = df.filter(F.col(comp).isNotNull()).groupBy("image_id", "h", "w", comp).agg(
        *[make(plain).alias(n) for n, make in sums.items()]
    )
    return grouped.withColumns(_axes())


def _sums(values: tuple[str, ...], counts: tuple[str, ...]) -> dict:
    """The summaries of a component, each a function of what is done with an aggregate."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "area": lambda over: over(F.count("*")),
        "x0": lambda over: over(F.min("x")),
        "y0": lambda over: over(F.min("y")),
        "bw": lambda over: over(F.max("x")) - over(F.min("x")) + 1,
        "bh": lambda over: over(F.max("y")) - over(F.min("y")) + 1,
        "cx": lambda over: over(F.avg(x)),
        "cy": lambda over: over(F.avg(y)),
        "var_x": lambda over: zero(over(F.var_samp(x))),
        "var_y": lambda over: zero(over(F.var_samp(y))),
        "cov_xy": lambda over: zero(over(F.covar_samp(x, y))),
        **{f"mean_{v}": lambda over, v=v: over(F.avg(v)) for v in values},
        **{f"max_{v}": lambda over, v=v: over(F.max(v)) for v in values},
        **{f"n_{c}": lambda over, c=c: over(F.count_if(F.col(c))) for c in counts},
    }


def _axes() -> dict[str, Column]:
    half = (F.col("var_x") + F.col("var_y")) / 2
    root = F.sqrt(F.pow((F.col("var_x") - F.col("var_y")) / 2, F.lit(2.0)) + F.col("cov_xy") * F.col("cov_xy"))
    return {
        "eig_max": half + root,
        "eig_min": half - root,
        "extent": F.col("area") / (F.col("bw") * F.col("bh")),
        "aspect": F.greatest("bw", "bh") / F.greatest(F.least("bw", "bh"), F.lit(1)),
    }


def axis_ratio(rule: str) -> Column:
    """Ratio of the principal axes; rules differ in their guard against thin shapes.

    ``floor``: eigenvalues at least 1e-3, under 3 cells gives 1; ``epsilon``:
    1e-6 added to both; ``eigen``: quotient of eigenvalues, not of axes.
    """
    big, small = F.col("eig_max"), F.abs("eig_min")
    if rule == "floor":
        low = F.greatest(small, F.lit(1e-3))
        return F.when(F.col("area") < 3, 1.0).otherwise(F.sqrt(F.greatest(big, low) / low))
    if rule == "epsilon":
        return F.when(F.col("area") < 3, 1.0).otherwise(F.sqrt((big + 1e-6) / (small + 1e-6)))
    if rule == "eigen":
        return big / (small + 1e-6)
    raise ValueError(rule)


def major_axis() -> Column:
    """Length of the principal axis, four standard deviations."""
    return 4.0 * F.sqrt(F.greatest("eig_max", F.lit(0.0)))


def keep(df: DataFrame, stats: DataFrame, rule: Column, out: str, comp: str = "comp") -> DataFrame:
    """Boolean column: the cell's component satisfies ``rule`` over its statistics."""
    good = stats.filter(rule).select("image_id", comp, F.lit(True).alias("_good"))
    return df.join(good, ["image_id", comp], "left").withColumn(out, F.coalesce("_good", F.lit(False))).drop("_good")


def keep_where(
    df: DataFrame, rule: Column, out: str, comp: str = "comp", values: tuple[str, ...] = (), counts: tuple[str, ...] = (),
    same: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` by a rule over ``component_stats`` and the columns ``same``, which are equal throughout an image.

    Small rasters are read once, with a window over the component, on partitions by image that later steps share.
    """
    sums = _sums(values, counts)
    if not small_rasters(df) or set(df.columns) & {*sums, *_axes()}:
        df = settled(df)
        return keep(df, component_stats(df, comp, values, counts, {c: F.first(c) for c in same}), rule, out, comp)
    one = Window.partitionBy("image_id", comp)
    made = df.repartition("image_id").withColumns({n: make(lambda a: a.over(one)) for n, make in sums.items()}).withColumns(_axes())
    return made.withColumn(out, F.coalesce(F.col(comp).isNotNull() & rule, F.lit(False))).drop(*sums, *_axes())


def min_area(df: DataFrame, n: int | Column, out: str, comp: str = "comp") -> DataFrame:
    return keep_where(df, F.col("area") >= n, out, comp)


def top_k(df: DataFrame, k: int, out: str, comp: str = "comp") -> DataFrame:
    """The k largest components of each image, higher label first on ties."""
    if small_rasters(df):
        return _first_by_area(df, k, out, comp, F.col(comp).desc())
    order = Window.partitionBy("image_id").orderBy(F.col("area").desc(), F.col(comp).desc())
    areas = df.filter(F.col(comp).isNotNull()).groupBy("image_id", comp).agg(F.count("*").alias("area"))
    ranked = areas.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    return keep(df, ranked, F.lit(True), out, comp)


def largest(df: DataFrame, out: str, comp: str = "comp") -> DataFrame:
    """The largest component of each image, lowest label on ties."""
    if small_rasters(df):
        return _first_by_area(df, 1, out, comp, F.col(comp))
    order = Window.partitionBy("image_id").orderBy(F.col("area").desc(), F.col(comp))
    areas = df.filter(F.col(comp).isNotNull()).groupBy("image_id", comp).agg(F.count("*").alias("area"))
    ranked = areas.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 1)
    return keep(df, ranked, F.lit(True), out, comp)


def _first_by_area(df: DataFrame, k: int, out: str, comp: str, ties: Column) -> DataFrame:
    """The first k components of each small raster; cells outside come last in the order."""
    area = F.count(comp).over(Window.partitionBy("image_id", comp))
    order = Window.partitionBy("image_id").orderBy(F.col("_area").desc(), ties)
    ranked = df.repartition("image_id").withColumn("_area", area).withColumn("_r", F.dense_rank().over(order))
    return ranked.withColumn(out, F.col(comp).isNotNull() & (F.col("_r") <= k)).drop("_area", "_r")


def drop_border(df: DataFrame, band: int, out: str, comp: str = "comp") -> DataFrame:
    """Drop components with any cell in the outermost ``band`` rows or columns."""
    inside = (
        (F.col("x0") >= band)
        & (F.col("y0") >= band)
        & (F.col("x0") + F.col("bw") <= F.col("w") - band)
        & (F.col("y0") + F.col("bh") <= F.col("h") - band)
    )
    return keep_where(df, inside, out, comp)


def drop_edge_lines(
    df: DataFrame, margin: int, out: str, aspect: float = 5.0, fill: float = 0.12, comp: str = "comp"
) -> DataFrame:
    """Drop line-shaped components near the frame."""
    near = (
        (F.col("x0") <= margin)
        | (F.col("y0") <= margin)
        | (F.col("x0") + F.col("bw") >= F.col("w") - margin)
        | (F.col("y0") + F.col("bh") >= F.col("h") - margin)
    )
    artefact = near & (F.col("aspect") >= aspect) & (F.col("extent") >= fill)
    return keep_where(df, ~artefact, out, comp)


def keep_elongated(df: DataFrame, aspect: float, area: int, out: str, comp: str = "comp") -> DataFrame:
    rule = (F.col("area") >= area) & (F.col("aspect") >= aspect)
    return keep_where(df, rule, out, comp)


def shape_rule(area: int, small_area: int = 5, ratio: float = 2.2, length: int = 4, skeleton: str = "skel") -> Column:
    """Large, or small but elongated with a long enough centre line (``n_<skeleton>``)."""
    thin = (F.col("area") >= max(small_area, 2)) & (
        F.sqrt((F.col("eig_max") + 1e-6) / (F.abs("eig_min") + 1e-6)) >= ratio
    )
    return (F.col("area") >= area) | (thin & (F.col(f"n_{skeleton}") >= length))


def vessel_like(area: int, length: int, ratio: float) -> Column:
    """Large, or at least 3 cells with an elongated principal axis."""
    thin = F.sqrt((F.col("eig_max") + 1e-6) / (F.abs("eig_min") + 1e-6)) >= ratio
    return (F.col("area") >= area) | ((F.col("area") >= 3) & thin & (major_axis() >= length))


def fill_holes(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Fill background regions (4-connected) that do not reach the frame."""
    back = label(df.withColumn("_bg", ~F.col(mask)), "_bg", "_bgc", conn=4)
    enclosed = drop_border(back, 1, "_hole", "_bgc")
    return enclosed.withColumn(out, F.col(mask) | F.col("_hole")).drop("_bg", "_bgc", "_hole")


def touches(df: DataFrame, comp: str, flag: str) -> DataFrame:
    """Components with at least one cell where ``flag`` holds."""
    return df.filter(F.col(comp).isNotNull() & F.col(flag)).select("image_id", comp).distinct()


def ring(df: DataFrame, mask: str, k: int, out: str) -> DataFrame:
    """Cells within a k x k square of the mask but not in it."""
    from cellgrove.functions.kernels import square
    from cellgrove.operators.morphology import dilate

    grown = dilate(df, mask, square(k), "_grown")
    return grown.withColumn(out, F.col("_grown") & ~F.col(mask)).drop("_grown")
