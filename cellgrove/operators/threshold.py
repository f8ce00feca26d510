"""Per-image thresholds and hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators import components as P
from cellgrove.operators.cells import SIZE, join_stats, settled, with_stats
from cellgrove.operators.masked import active_percentiles, inside, with_active
from cellgrove.operators.quantiles import group_stats, small_rasters
from cellgrove.operators.ranking import bucketed_row_number
from cellgrove.session import shared

ID = ["image_id"]


def density_cutoff(df: DataFrame, value: str, mask: str, density: float, out: str = "cutoff", least: int = 16) -> DataFrame:
    """Value above which the top ``density`` of the positive masked values lie.

    Images with fewer than ``least`` of them, or without range, get 0.5.
    """
    v = F.when(F.col(value) > 0, inside(value, mask))
    stats = group_stats(
        df, ID, {"_q": (v, 1.0 - density)}, {"_n": F.count(v), "_range": F.max(v) - F.min(v)}, SIZE
    )
    usable = (F.col("_n") >= least) & (F.col("_range") >= 1e-6)
    return stats.select("image_id", F.when(usable, F.col("_q")).otherwise(0.5).alias(out))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal bins between each image's smallest and largest counted value.

    Only bins that hold a value have a row: an image has at most ``bins`` of them, and no more than cells.
    """
    counted = df.select("image_id", *[c for c in ("h", "w") if c in df.columns], value.alias("v")).filter("v is not null")
    at = with_stats(counted, {}, {"lo": F.min("v"), "hi": F.max("v")})
    bin_of = F.when(
        F.col("hi") > F.col("lo"),
        F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    return at.select("image_id", "lo", "hi", bin_of.cast("int").alias("bin")).groupBy("image_id", "lo", "hi", "bin").agg(F.count("*").alias("c"))


def _centre(bins: int) -> Column:
    return F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins


def otsu_cutoff(df: DataFrame, value: Column, out: str = "cutoff", bins: int = 256) -> DataFrame:
    """Bin centre that maximises the variance between the two classes it separates."""
    up = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    h = histogram(df, value, bins).withColumn("m", F.col("c") * _centre(bins))
    h = h.withColumns(
        {"w1": F.sum("c").over(up), "s1": F.sum("m").over(up), "w": F.sum("c").over(whole), "s": F.sum("m").over(whole)}
    )
    w2, s2 = F.col("w") - F.col("w1"), F.col("s") - F.col("s1")
    apart = F.col("w1") * w2 * F.pow(F.col("s1") / F.col("w1") - s2 / w2, F.lit(2.0))
    scored = h.filter((F.col("w1") > 0) & (F.col("w") > F.col("w1"))).withColumn("_score", F.round(apart, 9))
    best = scored.groupBy(*ID).agg(F.max_by(_centre(bins), F.struct("_score", -F.col("bin"))).alias(out))
    only = h.groupBy(*ID).agg(F.min("lo").alias("_lo"))
    return only.join(best, ID, "left").select("image_id", F.coalesce(out, "_lo").alias(out))


def triangle_cutoff(df: DataFrame, value: Column, out: str = "cutoff", bins: int = 256) -> DataFrame:
    """Bin farthest below the line from the histogram's peak to its longer tail.

    NULL where the peak is the tail's end, so that the caller can fall back. In a run
    of empty bins the one next to the peak's side is farthest below the line, so each
    bin that holds a value brings the empty bin that follows it away from the peak.
    """
    whole, along_bins = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("bin")
    held = histogram(df, value, bins).withColumns(
        {
            "peak": F.max_by("bin", F.struct("c", -F.col("bin"))).over(whole),
            "top": F.max("c").over(whole),
            "first": F.min("bin").over(whole),
            "last": F.max("bin").over(whole),
            "_before": F.lag("bin").over(along_bins),
            "_after": F.lead("bin").over(along_bins),
        }
    )
    tail_right = F.col("peak") - F.col("first") < F.col("last") - F.col("peak")
    width = F.when(tail_right, F.col("last") - F.col("peak")).otherwise(F.col("peak") - F.col("first"))
    along = F.when(tail_right, F.col("last") - F.col("bin")).otherwise(F.col("bin") - F.col("first"))
    norm = F.sqrt(F.pow("top", F.lit(2.0)) + F.pow("width", F.lit(2.0)))
    below = (F.col("top") * F.col("along") - F.col("width") * F.col("c")) / norm
    following = F.when(tail_right, F.col("bin") + 1).otherwise(F.col("bin") - 1)
    empty = F.when(tail_right, F.col("_after") > following).otherwise(F.col("_before") < following)
    here = F.struct("bin", "c")
    both = F.array(here, F.struct(following.alias("bin"), F.lit(0).cast("long").alias("c")))
    tried = (
        held.withColumn("width", width)
        .withColumn("_tried", F.explode(F.when(empty, both).otherwise(F.array(here))))
        .withColumns({"bin": F.col("_tried.bin"), "c": F.col("_tried.c")})
        .withColumn("along", along)
    )
    ranged = (F.col("along") >= 0) & (F.col("along") < F.col("width"))
    order = F.when(ranged, F.struct(F.round(below, 9), -F.col("along")))
    return tried.groupBy(*ID).agg(F.max_by(_centre(bins), order).alias(out))


def _top_share(v: Column, density: float) -> tuple[dict, dict, Column]:
    """Percentile of the top share, what tells whether it can be used, and whether it can."""
    aggs = {"_n": F.count(v), "_least": F.min(v), "_most": F.max(v)}
    return {"_q": (v, 1.0 - density)}, aggs, (F.col("_n") >= 16) & (F.col("_most") - F.col("_least") >= 1e-6)


def cutoff(df: DataFrame, value: str, mask: str, method: str, density: float, out: str = "cutoff", bins: int = 256) -> DataFrame:
    """Threshold per image: ``percentile``, ``otsu``, ``triangle`` or ``hybrid``.

    Only positive masked values count. Few values or no range give 0.5; a
    triangle without a tail falls back on the percentile.
    """
    v = F.when(F.col(value) > 0, inside(value, mask))
    spec, aggs, usable = _top_share(v, density)
    base = group_stats(df, ID, spec, aggs, SIZE)
    pick = F.col("_q")
    if method == "otsu":
        base, pick = base.join(otsu_cutoff(df, v, "_t", bins), ID, "left"), F.coalesce("_t", "_q")
    elif method in ("triangle", "hybrid"):
        base = base.join(triangle_cutoff(df, v, "_t", bins), ID, "left")
        pick = F.coalesce("_t", "_q") if method == "triangle" else F.least("_t", "_q")
    elif method != "percentile":
        raise ValueError(method)
    return base.select("image_id", F.when(usable, pick).otherwise(0.5).alias(out))


def threshold(df: DataFrame, value: str, mask: str, method: str, density: float, out: str, bins: int = 256) -> DataFrame:
    if method == "percentile":
        spec, aggs, usable = _top_share(F.when(F.col(value) > 0, inside(value, mask)), density)
        at = with_stats(df, spec, aggs)
        return at.withColumn(out, F.col(mask) & (F.col(value) >= F.when(usable, F.col("_q")).otherwise(0.5))).drop(*spec, *aggs)
    cut_at = cutoff(df, value, mask, method, density, "_cut", bins)
    return join_stats(df, cut_at).withColumn(out, F.col(mask) & (F.col(value) >= F.col("_cut"))).drop("_cut")


def quantiles_at(df: DataFrame, value: Column, at: DataFrame, out: str, bins: int = 256) -> DataFrame:
    """image_id and the percentile ``out`` of ``value`` at each image's own share ``p`` (of ``at``: image_id, p).

    Linear interpolation between ranks, exact. Values are counted per (image,
    value) and ranked inside (image, value bin), so that no image is sorted in one
    task. Images without a value get null.
    """
    rows = df.select("image_id", value.cast("double").alias("v")).filter("v is not null")
    edges = rows.groupBy(*ID).agg(F.min("v").alias("_mn"), F.max("v").alias("_mx"), F.count("*").alias("_n")).join(at, ID)
    place = F.col("p") * (F.col("_n") - 1)
    edges = edges.withColumns({"_lo": F.floor(place), "_hi": F.ceil(place), "_part": place - F.floor(place)})
    bin_of = F.floor((F.col("v") - F.col("_mn")) / F.greatest(F.col("_mx") - F.col("_mn"), F.lit(1e-300)) * bins)
    counted = rows.groupBy("image_id", "v").agg(F.count("*").alias("c")).join(edges, ID)
    ranked = bucketed_row_number(counted, ID, [(F.least(bin_of, F.lit(bins - 1)), True)], [F.col("v")], "_rn", F.col("c"), "_end")
    holds = lambda rank: F.max(F.when((F.col("_end") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("_end")), F.col("v")))
    picked = ranked.groupBy(*ID).agg(holds("_lo").alias("a"), holds("_hi").alias("b"), F.first("_part").alias("f"))
    found = picked.select("image_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(out))
    return at.select("image_id").join(found, ID, "left")


def elbow_density(
    df: DataFrame, value: str, mask: str, lo: float = 0.06, hi: float = 0.16, least: int = 100, bins: int = 256
) -> DataFrame:
    """Density at the elbow of the cumulative curve, clamped; 0.5 for few values.

    Sorted positive values are summed up per image; the elbow is where the
    running share departs most from the running rank. Running sums are built per
    (image, value bin), so one huge raster is not sorted in one task.
    """
    counted = df.select("image_id", "y", "x", F.when(F.col(value) > 0, inside(value, mask)).alias("v")).filter("v is not null")
    edges = counted.groupBy(*ID).agg(
        F.min("v").alias("_mn"), F.max("v").alias("_mx"), F.count("*").alias("_n"), F.sum("v").alias("_total")
    )
    bin_of = F.floor((F.col("v") - F.col("_mn")) / F.greatest(F.col("_mx") - F.col("_mn"), F.lit(1e-300)) * bins)
    curve = bucketed_row_number(
        counted.join(edges, ID), ID, [(F.least(bin_of, F.lit(bins - 1)), True)], [F.col("v"), F.col("y"), F.col("x")],
        "_rn", F.col("v"), "_sum",
    )
    index = F.col("_rn") - 1
    away = F.round(F.abs(F.col("_sum") / F.col("_total") - index / F.col("_n")), 12)
    knee = curve.groupBy("image_id", "_n").agg(F.max_by(index, F.struct(away, -index)).alias("_k"))
    share = F.greatest(F.lit(lo), F.least(F.lit(hi), 1.0 - F.col("_k") / F.col("_n")))
    found = knee.select("image_id", F.when(F.col("_n") >= least, share).otherwise(0.5).alias("density"))
    everyone = df.select("image_id").distinct()
    return everyone.join(found, ID, "left").withColumn("density", F.coalesce("density", F.lit(0.5)))


def sauvola(
    df: DataFrame, value: str, window: int, k: float, r: float, out: str, border: str = "reflect101"
) -> DataFrame:
    """Local threshold mean * (1 + k * (std / r - 1))."""
    from cellgrove.operators.filters import local_mean_std

    local = local_mean_std(df, value, window, "_lm", "_ls", border)
    return local.withColumn(out, F.col("_lm") * (1.0 + k * (F.col("_ls") / r - 1.0))).drop("_lm", "_ls")


def local_adaptive(
    df: DataFrame, value: str, support: str, mask: str, out: str, window: int = 41, k: float = 0.05, r: float = 0.5
) -> DataFrame:
    """Above the local threshold plus 0.03, the active p78, and the support's active p48."""
    local = sauvola(df, value, window, k, r, "_local")
    floors = {"_g": (value, 0.78), "_s": (support, 0.48)}
    if small_rasters(local):
        at = with_active(local, floors, mask)
    else:
        at = join_stats(local, active_percentiles(df, floors, mask))
    rule = (F.col(value) >= F.greatest(F.col("_local") + 0.03, F.col("_g"))) & (F.col(support) >= F.col("_s"))
    return at.withColumn(out, rule & F.col(mask)).drop("_local", "_g", "_s")


def hysteresis(df: DataFrame, strong: str, weak: str, out: str, conn: int = 8, least: int | Column = 1) -> DataFrame:
    """Weak components that contain a strong cell (and have at least ``least`` cells)."""
    rule = (F.col(f"n_{strong}") > 0) & (F.col("area") >= least)
    return P.keep_where(P.label(df, weak, "_hc", conn), rule, out, "_hc", counts=(strong,)).drop("_hc")


def fixed_levels(df: DataFrame, value: str, mask: str, high: float, low: float, out: str) -> DataFrame:
    """Hysteresis at two fixed levels of a normalised response."""
    v, m = F.col(value), F.col(mask)
    marked = df.withColumns({"_st": (v >= high) & m, "_wk": (v >= low) & m})
    return hysteresis(marked, "_st", "_wk", out).drop("_st", "_wk")


def adaptive_levels(df: DataFrame, value: str, mask: str, bins: int = 256, least: int = 100) -> DataFrame:
    """Levels from each image's positive values: p92 and the triangle; few values give 0.5."""
    v = F.when(F.col(value) > 0, inside(value, mask))
    q = group_stats(df, ID, {"_p92": (v, 0.92), "_p70": (v, 0.70), "_p60": (v, 0.60)}, {"_n": F.count(v)}, SIZE)
    both = q.join(triangle_cutoff(df, v, "_t", bins), ID, "left")
    low = F.coalesce("_t", "_p70")
    low = F.when(F.col("_p92") <= low, F.greatest(F.col("_p60"), F.col("_p92") * 0.5)).otherwise(low)
    few = F.col("_n") < least
    return both.select(
        "image_id",
        F.when(few, 0.5).otherwise(F.col("_p92")).alias("high"),
        F.when(few, 0.5).otherwise(low).alias("low"),
    )


def density_levels(df: DataFrame, value: str, mask: str, density: float, low_mult: float, high_mult: float) -> DataFrame:
    """Levels from two densities around a target, each clipped to its allowed range."""
    return group_stats(df, ID, _density_spec(value, mask, density, low_mult, high_mult), size=SIZE)


def _density_spec(value: str, mask: str, density: float, low_mult: float, high_mult: float) -> dict:
    low = min(max(density * low_mult, 0.015), 0.20)
    high = min(max(density * high_mult, 0.008), low * 0.85)
    v = inside(value, mask)
    return {"low": (v, 1.0 - low), "high": (v, 1.0 - high)}


def small_area(share: float, least: int, most: int) -> Column:
    """Area limit proportional to the squared shorter side, rounded and clipped."""
    side = F.least("h", "w").cast("double")
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(side * side * share, 0).cast("int")))


def density_hysteresis(
    df: DataFrame, value: str, mask: str, out: str, density: float, low_mult: float = 1.28, high_mult: float = 0.50
) -> DataFrame:
    """Hysteresis between two density levels; images where nothing survives keep the strong cells."""
    v, m = F.col(value), F.col(mask)
    marked = with_stats(settled(df), _density_spec(value, mask, density, low_mult, high_mult)).withColumns(
        {"_st": F.coalesce((v >= F.col("high")) & m, F.lit(False)), "_wk": F.coalesce((v >= F.col("low")) & m, F.lit(False))}
    ).drop("high", "low")
    grown = hysteresis(marked, "_st", "_wk", "_hy", 8, small_area(0.000035, 8, 28))
    return (
        with_stats(grown, {}, {"_any": F.bool_or("_hy")})
        .withColumn(out, F.when(F.col("_any"), F.col("_hy")).otherwise(F.col("_st")) & m)
        .drop("_st", "_wk", "_hy", "_any")
    )


def triangle_or_p90(df: DataFrame, value: str, mask: str, bins: int, out: str) -> DataFrame:
    """Triangle threshold over all masked values, p90 where it has no tail."""
    v = inside(value, mask)
    q = group_stats(df, ID, {"_q": (v, 0.90)}, size=SIZE)
    t = triangle_cutoff(df, v, "_t", bins)
    return q.join(t, ID, "left").select("image_id", F.coalesce("_t", "_q", F.lit(1.0)).alias(out))


def triangle_hysteresis(
    df: DataFrame, value: str, mask: str, out: str, bins: int = 8, ratio: float = 0.70, strong_p: float = 0.90, weak_p: float = 0.75
) -> DataFrame:
    """Strong above triangle and percentile, weak above a share of it and a percentile, 4-connected."""
    df = shared(df)
    v = inside(value, mask)
    tri = triangle_or_p90(df, value, mask, bins, "_tri")
    q = group_stats(df, ID, {"_sp": (v, strong_p), "_wp": (v, weak_p)}, size=SIZE)
    high = F.greatest("_tri", "_sp")
    levels = tri.join(q, ID).select("image_id", high.alias("_hi"), F.greatest(high * ratio, F.col("_wp")).alias("_lo"))
    m = F.col(mask)
    marked = join_stats(df, levels).withColumns(
        {"_st": m & (F.col(value) >= F.col("_hi")), "_wk": m & (F.col(value) >= F.col("_lo"))}
    ).drop("_hi", "_lo")
    return hysteresis(marked, "_st", "_wk", out, 4).drop("_st", "_wk")


def connected_levels(
    df: DataFrame,
    value: str,
    mask: str,
    out: str,
    high: float,
    low: float,
    area: int,
    support: str | None = None,
    support_floor: float = 0.0,
    support_p: float = 0.35,
) -> DataFrame:
    """Active-percentile hysteresis behind a support gate, then the shape rule."""
    from cellgrove.operators.skeleton import thin

    spec = {"_hi": (value, high), "_lo": (value, low)}
    if support:
        spec["_sf"] = (support, support_p)
    at = with_active(settled(df), spec, mask)
    gate = F.col(mask)
    if support:
        gate = gate & (F.col(support) >= F.greatest(F.lit(support_floor), F.col("_sf")))
    v = F.col(value)
    marked = at.withColumns({"_st": gate & (v >= F.col("_hi")), "_wk": gate & (v >= F.col("_lo"))}).drop(*spec)
    joined = settled(hysteresis(marked, "_st", "_wk", "_hy", 4))
    lines = P.label(thin(joined, "_hy", "_sk"), "_hy", "_cc")
    kept = P.keep_where(lines, P.shape_rule(area, skeleton="_sk"), out, "_cc", counts=("_sk",))
    return kept.drop("_st", "_wk", "_hy", "_sk", "_cc")


def evidence_hysteresis(df: DataFrame, value: str, evidence: str, mask: str, out: str) -> DataFrame:
    """Hysteresis whose cells also need line evidence; images without strong cells keep the weak ones."""
    df = shared(df)
    m, v, e = F.col(mask), F.col(value), F.col(evidence)
    active = active_percentiles(df, {"_a68": (value, 0.68), "_a42": (value, 0.42)}, mask, 0.01, 0.30)
    tri = triangle_or_p90(df, value, mask, 4, "_tri")
    ev = group_stats(df, ID, {"_e58": (inside(evidence, mask), 0.58), "_e76": (inside(evidence, mask), 0.76)}, size=SIZE)
    high = F.greatest(F.col("_tri") * 0.95, F.col("_a68"))
    levels = active.join(tri, ID).join(ev, ID).select(
        "image_id",
        high.alias("_hi"),
        F.greatest(high * 0.56, F.col("_a42")).alias("_lo"),
        F.greatest(F.lit(0.12), F.col("_e58")).alias("_ef"),
        F.greatest(F.lit(0.22), F.col("_e76")).alias("_eh"),
    )
    at = join_stats(df, levels)
    strong = m & (v >= F.col("_hi")) & (e >= F.col("_ef"))
    near = (v >= F.col("_hi") * 0.82) & (e >= F.col("_eh") * 0.70)
    weak = m & (v >= F.col("_lo")) & ((e >= F.col("_ef")) | near)
    no = F.lit(False)
    marked = at.withColumns({"_st": F.coalesce(strong, no), "_wk": F.coalesce(weak, no)}).drop("_hi", "_lo", "_ef", "_eh")
    grown = hysteresis(marked, "_st", "_wk", "_hy", 4)
    return (
        with_stats(grown, {}, {"_any": F.bool_or("_st")})
        .withColumn(out, F.when(F.col("_any"), F.col("_hy")).otherwise(F.col("_wk")))
        .drop("_st", "_wk", "_hy", "_any")
    )


def mask_and(*masks: str) -> Column:
    out = F.col(masks[0])
    for m in masks[1:]:
        out = out & F.col(m)
    return out


def mask_or(*masks: str) -> Column:
    out = F.col(masks[0])
    for m in masks[1:]:
        out = out | F.col(m)
    return out


def mask_minus(a: str, b: str) -> Column:
    return F.col(a) & ~F.col(b)
