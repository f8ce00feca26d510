"""Per-image order statistics inside a mask, and the scalings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.colour import clip
from cellgrove.operators.cells import SIZE, join_stats, with_stats
from cellgrove.operators.quantiles import group_stats, small_rasters

ID = ["image_id"]


def inside(value: str, mask: str | None) -> Column:
    """The value where it counts: finite and inside the mask, NULL elsewhere."""
    finite = ~F.isnan(F.col(value)) & (F.abs(F.col(value)) < float("inf"))
    return F.when(finite & F.col(mask) if mask else finite, F.col(value))


def normalise(
    df: DataFrame, value: str, mask: str | None, out: str, variant: str = "fallback", lo: float = 0.01, hi: float = 0.99
) -> DataFrame:
    """Scale each image to [0, 1] between two percentiles of its masked values.

    ``fallback``: equal percentiles fall back on min and max, then on zero.
    ``floor``: the range is at least 1e-8 and nothing else falls back.
    ``masked``: as ``fallback``, an empty mask uses all cells, outside is zero.
    """
    v = inside(value, mask)
    spec = {"_lo": (v, lo), "_hi": (v, hi)}
    aggs = {"_min": F.min(v), "_max": F.max(v)}
    if variant == "masked" and mask:
        u = inside(value, None)
        spec |= {"_ulo": (u, lo), "_uhi": (u, hi)}
        aggs |= {"_umin": F.min(u), "_umax": F.max(u)}
    at = with_stats(df, spec, aggs)
    if variant == "masked" and mask:
        at = at.withColumns({f"_{c}": F.coalesce(f"_{c}", f"_u{c}") for c in ("lo", "hi", "min", "max")})
    low, high = F.col("_lo"), F.col("_hi")
    if variant == "floor":
        scaled = clip((F.col(value) - low) / F.greatest(high - low, F.lit(1e-8)))
    else:
        wide = high > low
        low = F.when(wide, low).otherwise(F.col("_min"))
        high = F.when(wide, high).otherwise(F.col("_max"))
        scaled = F.when(high > low, clip((F.col(value) - low) / (high - low))).otherwise(0.0)
    if variant == "masked" and mask:
        scaled = F.when(F.col(mask), scaled).otherwise(0.0)
    # an image without any counted value becomes zeros
    return at.withColumn(out, F.coalesce(scaled, F.lit(0.0))).drop(*spec, *aggs)


def stretch_u8(df: DataFrame, value: str, mask: str, out: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Percentile stretch to whole numbers 0..255, zero outside the mask."""
    scaled = normalise(df, value, mask, "_s", "fallback", lo, hi)
    return scaled.withColumn(out, F.when(F.col(mask), F.bround(F.col("_s") * 255.0, 0)).otherwise(0.0)).drop("_s")


def percentile_floor(
    df: DataFrame, value: str, mask: str, out: str, lo: float, hi: float, gamma: float = 1.0
) -> DataFrame:
    """Cut below a percentile, scale to the upper one, apply a power; zero outside.

    Images whose percentiles coincide are normalised instead, without the power.
    """
    v = inside(value, mask)
    spec = {"_lo": (v, lo), "_hi": (v, hi), "_p1": (v, 0.01), "_p99": (v, 0.99)}
    at = with_stats(df, spec, {"_min": F.min(v), "_max": F.max(v)})
    wide = F.col("_p99") > F.col("_p1")
    low, high = F.when(wide, F.col("_p1")).otherwise(F.col("_min")), F.when(wide, F.col("_p99")).otherwise(F.col("_max"))
    plain = F.when(high > low, clip((F.col(value) - low) / (high - low))).otherwise(0.0)
    floored = F.pow(clip((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))), F.lit(float(gamma)))
    scaled = F.when(F.col("_hi") > F.col("_lo"), floored).otherwise(plain)
    return at.withColumn(out, F.when(F.col(mask), F.coalesce(scaled, F.lit(0.0))).otherwise(0.0)).drop(*spec, "_min", "_max")


def masked_median(df: DataFrame, value: str, mask: str, out: str = "median") -> DataFrame:
    """Median per image inside the mask, 0 where the mask is empty."""
    stats = group_stats(df, ID, {out: (inside(value, mask), 0.5)}, size=SIZE)
    return stats.withColumn(out, F.coalesce(out, F.lit(0.0)))


def fill_median(df: DataFrame, value: str, mask: str, out: str) -> DataFrame:
    """Replace values outside the mask by the image's masked median."""
    filled = F.when(F.col(mask), F.col(value)).otherwise(F.coalesce("_med", F.col(value)))
    return with_stats(df, {"_med": (inside(value, mask), 0.5)}).withColumn(out, filled).drop("_med")


def active_percentiles(
    df: DataFrame, specs: dict[str, tuple[str, float]], mask: str, least: float = 0.02, base: float = 0.35
) -> DataFrame:
    """Per-image percentiles of the active values of one or more columns.

    Active means above ``max(least, p35)`` of the masked values; an image
    without active values uses all of them, an empty mask gives 1.
    """
    floored, wanted, _ = _active(df, specs, mask, least, base)
    found = group_stats(floored, ID, wanted, size=SIZE)
    return found.select("image_id", *[c.alias(n) for n, c in _active_or_all(specs).items()])


def _active(df, specs, mask, least, base):
    """The cells with the floors of the named columns, the percentiles wanted above and without them, and the floors' names."""
    columns = sorted({c for c, _ in specs.values()})
    floored = with_stats(df, {f"_f_{c}": (inside(c, mask), base) for c in columns})
    every = {c: inside(c, mask) for c in columns}
    above = {c: F.when(F.col(c) > F.greatest(F.lit(least), F.col(f"_f_{c}")), every[c]) for c in columns}
    wanted = {}
    for name, (c, p) in specs.items():
        wanted |= {f"_a_{name}": (above[c], p), f"_b_{name}": (every[c], p)}
    return floored, wanted, [f"_f_{c}" for c in columns]


def _active_or_all(specs):
    return {n: F.coalesce(f"_a_{n}", f"_b_{n}", F.lit(1.0)) for n in specs}


def with_active(
    df: DataFrame, specs: dict[str, tuple[str, float]], mask: str, least: float = 0.02, base: float = 0.35
) -> DataFrame:
    """The cells with ``active_percentiles`` of their image as columns."""
    if not small_rasters(df):
        return join_stats(df, active_percentiles(df, specs, mask, least, base))
    floored, wanted, floors = _active(df, specs, mask, least, base)
    return with_stats(floored, wanted).withColumns(_active_or_all(specs)).drop(*wanted, *floors)


def response_features(df: DataFrame, value: str, mask: str, prefix: str) -> DataFrame:
    """Mean, population deviation, p90, p95, p99 and skew; 0 for an empty mask."""
    v = inside(value, mask)
    stats = group_stats(
        df,
        ID,
        {"p90": (v, 0.90), "p95": (v, 0.95), "p99": (v, 0.99)},
        {"m1": F.avg(v), "sd": F.stddev_pop(v), "g1": F.skewness(v)},
        SIZE,
    )
    cubed = F.pow("sd", F.lit(3.0))  # moments about the mean: raw ones cancel
    return stats.select(
        "image_id",
        *[
            F.coalesce(c, F.lit(0.0)).alias(f"{prefix}_{n}")
            for n, c in (
                ("mean", F.col("m1")),
                ("std", F.col("sd")),
                ("p90", F.col("p90")),
                ("p95", F.col("p95")),
                ("p99", F.col("p99")),
                ("skew", F.when(F.col("sd") > 0, F.col("g1") * cubed / (cubed + 1e-6))),
            )
        ],
    )


def intensity_features(df: DataFrame, by: list[str], cols: list[str], mask: Column | None = None) -> DataFrame:
    """Mean and population deviation of each channel; 0 where nothing counts."""
    pick = (lambda c: F.when(mask, F.col(c))) if mask is not None else F.col
    return df.groupBy(*by).agg(
        *[F.coalesce(F.avg(pick(c)), F.lit(0.0)).alias(f"int_{c}_mean") for c in cols],
        *[F.coalesce(F.stddev_pop(pick(c)), F.lit(0.0)).alias(f"int_{c}_std") for c in cols],
    )


def coverage_stats(df: DataFrame, mask: str) -> DataFrame:
    """Spread of the mask's share over all images, and counts of extreme images."""
    share = df.groupBy("image_id").agg(F.avg(F.col(mask).cast("double")).alias("share"))
    return share.agg(
        F.min("share").alias("min_share"),
        F.avg("share").alias("mean_share"),
        F.max("share").alias("max_share"),
        F.count_if(F.col("share") > 0.98).alias("n_full"),
        F.count_if(F.col("share") < 0.2).alias("n_sparse"),
    )


def noise_score(df: DataFrame, response: str, support: str, coherence: str, mask: str) -> DataFrame:
    """Share of masked cells that respond but lack line support, and the gate strength."""
    at, share = _noisy(df, response, support, coherence, mask)
    return at.groupBy("image_id").agg(F.coalesce(share, F.lit(0.0)).alias("noise")).withColumn("strength", _strength(F.col("noise")))


def _strength(noise: Column) -> Column:
    return clip((F.coalesce(noise, F.lit(0.0)) - 0.10) / 0.18)


def with_noise_strength(df: DataFrame, response: str, support: str, coherence: str, mask: str, out: str) -> DataFrame:
    """The cells with the gate strength of their image."""
    if not small_rasters(df):
        score = noise_score(df, response, support, coherence, mask)
        return join_stats(df, score.select("image_id", F.col("strength").alias(out)))
    at, share = _noisy(df, response, support, coherence, mask)
    return with_stats(at, {}, {"_noise": share}).withColumn(out, _strength(F.col("_noise"))).drop("_r", "_s", "_c", "_noise")


def _noisy(df, response, support, coherence, mask):
    at = with_active(df, {"_r": (response, 0.65), "_s": (support, 0.48)}, mask)
    at = with_stats(at, {"_c": (inside(coherence, mask), 0.45)})
    noisy = (F.col(response) >= F.col("_r")) & (
        (F.col(support) < F.col("_s")) | (F.col(coherence) < F.greatest(F.lit(0.05), F.col("_c")))
    )
    return at, F.avg(F.when(F.col(mask), noisy.cast("double")))


def agreement(df: DataFrame, tests: list[Column], out: str) -> DataFrame:
    """Share of boolean tests that hold in each cell."""
    return df.withColumn(out, sum(t.cast("double") for t in tests) / float(len(tests)))
