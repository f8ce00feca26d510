"""Composites over components: fields of view, clean-ups, recovery, growth, feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.kernels import ellipse, square
from cellgrove.operators import components as P
from cellgrove.operators.cells import SIZE, join_stats, settled, with_stats
from cellgrove.operators.hulls import hull_areas
from cellgrove.operators.masked import inside, response_features, with_active
from cellgrove.operators.morphology import closing, dilate, opening
from cellgrove.operators.quantiles import group_stats, small_rasters
from cellgrove.operators.skeleton import line_points, thin
from cellgrove.operators.threshold import small_area
from cellgrove.session import cut, shared

ID = ["image_id"]


def fov_mask(
    df: DataFrame, grey: str, out: str, variant: str = "percentile", brightest: str | None = None,
    close: int = 15, open_: int = 5, conn: int = 8,
) -> DataFrame:
    """Field of view of each image.

    ``percentile``: above max(3, floor of p1), closed twice, holes filled, largest
    component. ``visible``: brightest channel over 8 or grey over 6, closed,
    opened, largest component, holes filled.
    """
    if variant == "percentile":
        lit = with_stats(df, {"_p1": (F.col(grey), 0.01)}).withColumn("_m", F.col(grey) > F.greatest(F.lit(3.0), F.floor("_p1"))).drop("_p1")
        shut = closing(lit, "_m", ellipse(close), "_c", times=2)
        full = settled(P.fill_holes(settled(shut), "_c", "_f"))
        big = P.largest(settled(P.label(full, "_f", "_k", conn)), out, "_k")
        return big.drop("_m", "_c", "_f", "_k")
    if variant == "visible":
        lit = df.withColumn("_m", (F.col(brightest) > 8) | (F.col(grey) > 6))
        smooth = opening(closing(lit, "_m", ellipse(close), "_c"), "_c", ellipse(open_), "_o")
        big = P.largest(P.label(settled(smooth), "_o", "_k", conn), "_b", "_k")
        return P.fill_holes(big, "_b", out).drop("_m", "_c", "_o", "_k", "_b")
    raise ValueError(variant)


def suppress_blobs(
    df: DataFrame, response: str, support: str, coherence: str, mask: str, out: str,
    area: int = 45, big: int = 90, ratio: float = 1.9, factor: float = 0.45,
) -> DataFrame:
    """Damp the response inside round, or large but unsupported, components of its active p78."""
    at = with_active(settled(df), {"_cut": (response, 0.78), "_sf": (support, 0.45)}, mask)
    at = with_stats(at, {"_cf": (inside(coherence, mask), 0.40)})
    marked = at.withColumn("_pre", F.col(mask) & (F.col(response) >= F.col("_cut")))
    lab = P.label(marked, "_pre", "_bc")
    weak = (F.col(f"mean_{support}") < F.col("_sf")) | (F.col(f"mean_{coherence}") < F.greatest(F.lit(0.05), F.col("_cf")))
    blob = (F.col("area") >= area) & ((P.axis_ratio("epsilon") < ratio) | ((F.col("area") >= big) & weak))
    hit = P.keep_where(lab, blob, "_blob", "_bc", (support, coherence), same=("_sf", "_cf"))
    damped = F.when(F.col("_blob"), F.col(response) * factor).otherwise(F.col(response))
    return hit.withColumn(out, F.when(F.col(mask), damped).otherwise(0.0)).drop("_cut", "_sf", "_cf", "_pre", "_bc", "_blob")


def recover_components(
    df: DataFrame, candidates: str, response: str, mask: str, out: str,
    ratio: float = 2.6, length: int | Column | None = None, branch_density: float = 0.12, area: int | Column | None = None,
) -> DataFrame:
    """Keep elongated, little-branched, strong enough candidate components."""
    v = inside(response, mask)
    q = {f"_p{p}": (v, p / 100.0) for p in (45, 82, 93)}
    at = with_stats(settled(df), q)
    lines = line_points(thin(at.withColumn("_cand", F.col(candidates) & F.col(mask)), "_cand", "_sk"), "_sk", "_ep", "_bp")
    lab = P.label(lines, "_cand", "_rc")
    side = F.least("h", "w")
    if length is None:
        length = F.greatest(F.lit(14), F.least(F.lit(28), F.bround(side * 0.026, 0).cast("int")))
    area = small_area(0.000025, 8, 24) if area is None else area
    mean, peak = F.col(f"mean_{response}"), F.col(f"max_{response}")
    strong = ((mean >= F.col("_p45")) & (peak >= F.col("_p82"))) | (peak >= F.col("_p93"))
    rule = (
        (F.col("area") >= area)
        & (P.axis_ratio("floor") >= ratio)
        & (F.col("n__sk") >= length)
        & (F.col("n__bp") / F.greatest("n__sk", F.lit(1)) <= branch_density)
        & strong
    )
    return P.keep_where(lab, rule, out, "_rc", (response,), ("_sk", "_bp"), tuple(q)).drop(*q, "_cand", "_sk", "_ep", "_bp", "_rc")


def clean_noise(
    df: DataFrame, mask: str, response: str, support: str, coherence: str, fov: str, out: str,
    large: int = 35, near: int = 8, like: tuple[int, int, float] = (12, 5, 1.9),
) -> DataFrame:
    """Keep large components, and elongated ones with signal, or near large ones with line signal."""
    at = with_active(settled(df), {"_rf": (response, 0.48), "_sf": (support, 0.42)}, fov)
    at = with_stats(at, {"_cf": (inside(coherence, fov), 0.35)})
    lab = P.label(at, mask, "_nc")
    big = P.min_area(lab, large, "_big", "_nc")
    ringed = dilate(big, "_big", ellipse(2 * near + 1), "_near")
    supported = F.col(f"mean_{support}") >= F.col("_sf")
    signal = supported & (F.col(f"mean_{response}") >= F.col("_rf"))
    line = supported & (F.col(f"mean_{coherence}") >= F.greatest(F.lit(0.05), F.col("_cf")))
    rule = (F.col("area") >= large) | (P.vessel_like(*like) & (signal | ((F.col("n__near") > 0) & line)))
    kept = P.keep_where(ringed, rule, out, "_nc", (response, support, coherence), ("_near",), ("_rf", "_sf", "_cf"))
    return kept.withColumn(out, F.col(out) & F.col(fov)).drop("_rf", "_sf", "_cf", "_nc", "_big", "_near")


def near_tree(
    df: DataFrame, seed: str, response: str, support: str, coherence: str, fov: str, out: str,
    response_p: float = 0.84, support_p: float = 0.38, radius: int = 10,
) -> DataFrame:
    """Thin candidate components close to a seed mask that look like lines and carry signal."""
    spec = {"_rf": (response, response_p), "_sf": (support, support_p), "_s55": (support, 0.55)}
    at = with_active(settled(df), spec, fov)
    at = with_stats(at, {"_cf": (inside(coherence, fov), 0.35)})
    cf = F.greatest(F.lit(0.06), F.col("_cf"))
    candidate = (
        F.col(fov)
        & (F.col(response) >= F.col("_rf"))
        & (F.col(support) >= F.col("_sf"))
        & ((F.col(coherence) >= cf) | (F.col(support) >= F.col("_s55")))
    )
    ringed = dilate(at.withColumn("_cand", F.coalesce(candidate, F.lit(False))), seed, ellipse(2 * radius + 1), "_near")
    lab = P.label(ringed, "_cand", "_tc")
    s = F.col(f"mean_{support}")
    confident = (F.col(f"mean_{response}") >= F.col("_rf")) & (s >= F.greatest(F.lit(0.08), F.col("_sf")))
    lined = (s >= F.greatest(F.lit(0.10), F.col("_sf"))) & (F.col(f"mean_{coherence}") >= cf)
    rule = (F.col("n__near") > 0) & (F.col("area") >= 4) & P.vessel_like(12, 5, 1.8) & (confident | lined)
    return P.keep_where(lab, rule, out, "_tc", (response, support, coherence), ("_near",), ("_rf", "_sf", "_cf")).drop(*spec, "_cf", "_cand", "_near", "_tc")


def _with_contact(df: DataFrame, seed: str, fov: str) -> DataFrame:
    """The seed and the cells within two of it."""
    return dilate(df.withColumn("_base", F.col(seed) & F.col(fov)), "_base", ellipse(5), "_contact")


def _prune(df: DataFrame, grown: str, response: str, support: str, fov: str, out: str) -> DataFrame:
    lab = P.label(df.withColumn("_new", F.col(grown) & ~F.col("_base") & F.col(fov)), "_new", "_gc")
    strong = (F.col(f"mean_{response}") >= 0.18) & (F.col(f"mean_{support}") >= 0.14)
    rule = (F.col("n__contact") > 0) & (P.vessel_like(6, 3, 1.6) | strong)
    kept = P.keep_where(lab, rule, "_ok", "_gc", (response, support), ("_contact",))
    return kept.withColumn(out, F.col("_base") | F.col("_ok")).drop("_new", "_gc", "_ok")


def prune_growth(
    df: DataFrame, grown: str, seed: str, response: str, support: str, fov: str, out: str
) -> DataFrame:
    """Seed plus those grown components that touch it and are line-like or strong."""
    near = _with_contact(df, seed, fov)
    return _prune(near, grown, response, support, fov, out).drop("_base", "_contact")


def grow_region(
    df: DataFrame, seed: str, candidate: str, response: str, support: str, fov: str, out: str, rounds: int = 7, least: int = 3
) -> DataFrame:
    """Grow a mask ring by ring into candidate cells, pruning after each round.

    An image stops on its own once a round adds fewer than ``least`` cells; the
    loop ends when all have stopped. Every round is written out.
    """
    near = _with_contact(df, seed, fov)
    state = cut(near.withColumns({"_acc": F.col("_base"), "_live": F.lit(True)}))
    for _ in range(rounds):
        ringed = dilate(state, "_acc", ellipse(3), "_ring")
        step = ringed.withColumn(
            "_grown", F.col("_acc") | (F.col("_live") & F.col("_ring") & F.col(candidate))
        )
        pruned = settled(_prune(step, "_grown", response, support, fov, "_next"))
        fresh = F.count_if(F.col("_next") & ~F.col("_acc") & F.col("_live"))
        go = F.col("_live") & (F.col("_added") >= least)
        state = with_stats(pruned, {}, {"_added": fresh}).withColumns(
            {"_acc": F.when(go, F.col("_next")).otherwise(F.col("_acc")), "_live": go}
        ).select(*state.columns)
        if small_rasters(state):
            state = cut(state)
        if state.filter("_live").isEmpty():
            break
    return _prune(state, "_acc", response, support, fov, out).drop("_acc", "_live", "_base", "_contact")


def shape_features(df: DataFrame, mask: str, fov: str, skeleton: bool = True) -> DataFrame:
    """Density, centre-line density, component sizes, spread and anisotropy per image."""
    lab = P.label(df, mask, "_sc")
    if skeleton:
        lab = thin(lab, mask, "_sk")
    sizes = lab.filter(F.col("_sc").isNotNull()).groupBy("image_id", "_sc").agg(F.count("*").alias("_a"))
    comp = sizes.groupBy("image_id").agg(
        F.count("*").cast("double").alias("n_components"),
        F.avg("_a").alias("comp_size_mean"),
        F.max("_a").cast("double").alias("comp_size_max"),
        F.stddev_pop("_a").alias("comp_size_std"),
    )
    on = F.col(mask)
    x, y = F.when(on, F.col("x").cast("double")), F.when(on, F.col("y").cast("double"))
    whole = lab.groupBy("image_id").agg(
        F.greatest(F.count_if(F.col(fov)), F.lit(1)).alias("_fov"),
        F.count_if(on).alias("_n"),
        *([F.count_if(F.col("_sk")).alias("_len")] if skeleton else []),
        F.var_pop(x).alias("_px"),
        F.var_pop(y).alias("_py"),
        F.var_samp(x).alias("_vx"),
        F.var_samp(y).alias("_vy"),
        F.covar_samp(x, y).alias("_cxy"),
    )
    half = (F.col("_vx") + F.col("_vy")) / 2
    root = F.sqrt(F.pow((F.col("_vx") - F.col("_vy")) / 2, F.lit(2.0)) + F.col("_cxy") * F.col("_cxy"))
    some = F.col("_n") > 4
    cols = {
        "vessel_density": F.col("_n") / F.col("_fov"),
        "vessel_spread": F.when(some, F.sqrt(F.col("_px") + F.col("_py"))).otherwise(0.0),
        "vessel_anisotropy": F.when(some, F.abs(half - root) / (half + root + 1e-6)).otherwise(0.0),
    }
    if skeleton:
        cols["skeleton_density"] = F.col("_len") / F.col("_fov")
        cols["tortuosity_proxy"] = F.col("_n") / (F.col("_len") + 1e-6)
    sized = ["n_components", "comp_size_mean", "comp_size_max", "comp_size_std"]
    return whole.join(comp, ID, "left").select(
        "image_id", *[c.alias(n) for n, c in cols.items()], *[F.coalesce(n, F.lit(0.0)).alias(n) for n in sized]
    )


def main_component_features(df: DataFrame, response: str, fov: str, skeleton: bool = True, density: float = 0.16) -> DataFrame:
    """Features of the largest component of the response's top share.

    Area share, elongation, extent, solidity, length, contrast to its surrounding
    ring, distance from the centre, and with ``skeleton`` the curvature, next to the
    response summary of the whole image. Images without a component get zeros.
    """
    df = shared(df)
    level = group_stats(df, ID, {"_cut": (inside(response, fov), 1.0 - density)}, size=SIZE)
    top = join_stats(df, level).withColumn("_bin", F.col(fov) & (F.col(response) >= F.col("_cut"))).drop("_cut")
    lab = shared(P.label(top, "_bin", "_mc"))
    counts = lab.groupBy("image_id").agg(
        F.greatest(F.count_if(F.col(fov)), F.lit(1)).alias("_fov"),
        (F.count_if(F.col("_bin")) / F.greatest(F.count_if(F.col(fov)), F.lit(1))).alias("ridge_density"),
        F.count_distinct("_mc").cast("double").alias("ridge_n_components"),
    )
    main = P.largest(lab, "_main", "_mc")
    if skeleton:
        main = thin(main, "_main", "_sk")
    around = shared(P.ring(main, "_main", 9, "_ring"))
    ringed = around.groupBy("image_id").agg(
        F.coalesce(F.avg(F.when(F.col("_ring") & F.col(fov), F.col(response))), F.lit(0.0)).alias("_ringmean")
    )
    one = around.withColumn("_one", F.when(F.col("_main"), F.col("_mc")))
    stats = P.component_stats(one, "_one", (response,), ("_sk",) if skeleton else ())
    hulls = hull_areas(one, "_one", "_hull").drop("_one")
    small = F.col("area") <= 2
    big = F.when(small, 1.0).otherwise(F.col("eig_max"))
    low = F.when(small, 1.0).otherwise(F.abs("eig_min"))
    length = F.when(big > 0, 4.0 * F.sqrt(big)).otherwise(0.0)
    away = F.sqrt(F.pow(F.col("cx") - F.col("w") / 2, F.lit(2.0)) + F.pow(F.col("cy") - F.col("h") / 2, F.lit(2.0)))
    diagonal = F.sqrt((F.col("w") * F.col("w") + F.col("h") * F.col("h")).cast("double")) / 2
    cols = {
        "ridge_main_area": F.col("area") / F.col("_fov"),
        "ridge_main_elong": big / (low + 1e-6),
        "ridge_main_extent": F.col("extent"),
        "ridge_main_solidity": F.col("area") / (F.greatest(F.col("area").cast("double"), F.col("_hull")) + 1e-6),
        "ridge_main_len": length / F.greatest("h", "w"),
        "ridge_main_contrast": F.col(f"mean_{response}") - F.col("_ringmean"),
        "ridge_center_dist": away / diagonal,
    }
    if skeleton:
        cols["ridge_main_curv"] = F.when(length > 0, F.col("n__sk") / (length + 1e-6)).otherwise(0.0)
    summary = response_features(df, response, fov, "ridge_resp").select(
        "image_id", "ridge_resp_mean", "ridge_resp_std", "ridge_resp_p95", "ridge_resp_p99"
    )
    joined = counts.join(stats, ID, "left").join(hulls, ID, "left").join(ringed, ID).join(summary, ID)
    return joined.select(
        "image_id",
        *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()],
        "ridge_density",
        "ridge_n_components",
        *[c for c in summary.columns if c != "image_id"],
    )
