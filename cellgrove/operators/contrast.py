"""Fusion, contrast curves and background removal over cell columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.colour import clip, lab_to_rgb, rgb_to_lab
from cellgrove.operators.cells import with_stats
from cellgrove.operators.masked import inside, normalise

# Weights of the named fusions.
FUSIONS = {
    "almeida": {"top_hat": 0.20, "matched": 0.40, "frangi": 0.15, "jerman": 0.25},
    "ensemble": {
        "top_hat": 0.14,
        "matched": 0.34,
        "frangi": 0.12,
        "jerman": 0.22,
        "sato": 0.08,
        "meijering": 0.06,
        "local_dark": 0.04,
    },
    "legacy_tophat": {"top_hat": 1.0},
}


def weighted(weights: dict[str, float]) -> Column:
    return sum(F.lit(float(w)) * F.col(c) for c, w in weights.items())


def fuse(df: DataFrame, weights: dict[str, float], mask: str, out: str, scale: bool = True) -> DataFrame:
    """Weighted sum of response columns, scaled to [0, 1] per image."""
    mixed = df.withColumn("_mix", weighted(weights))
    if not scale:
        return mixed.withColumnRenamed("_mix", out)
    return normalise(mixed, "_mix", mask, out).drop("_mix")


def gated(response: str, gates: list[tuple[str, float, float]]) -> Column:
    """Product of a response with gates ``a + b * signal``."""
    product = F.col(response)
    for signal, a, b in gates:
        product = product * (F.lit(a) + F.lit(b) * F.col(signal))
    return product


# Centre, dark and bright amplitude, dark and bright exponent.
CURVE = {"centre": 142.0, "dark": 118.0, "bright": 34.0, "dark_gamma": 0.72, "bright_gamma": 1.55}


def residual_contrast(
    df: DataFrame, value: str, background: str, mask: str, stats_mask: str, out: str, curve: dict = CURVE
) -> DataFrame:
    """Bend deviations from the background: dark ones up, bright ones down, 0..255.

    Median, p1 and p99 of the residual come from ``stats_mask`` (the eroded
    mask), or from ``mask`` in images where that is empty. Deviations from the median
    count to nine decimals: the steep end of the curve would turn the last bits of a
    mean into a whole level.
    """
    rest = df.withColumn("_res", F.col(value) - F.col(background))
    spec = {}
    for tag, m in (("s", stats_mask), ("m", mask)):
        v = inside("_res", m)
        spec |= {f"_{tag}mid": (v, 0.5), f"_{tag}lo": (v, 0.01), f"_{tag}hi": (v, 0.99)}
    at = with_stats(rest, spec).withColumns({f"_{c}": F.coalesce(f"_s{c}", f"_m{c}") for c in ("mid", "lo", "hi")})
    mid = F.col("_mid")
    dark = clip(F.round(mid - F.col("_res"), 9) / F.greatest(mid - F.col("_lo"), F.lit(1.0)))
    bright = clip(F.round(F.col("_res") - mid, 9) / F.greatest(F.col("_hi") - mid, F.lit(1.0)))
    bent = (
        curve["centre"]
        - curve["dark"] * F.pow(dark, F.lit(curve["dark_gamma"]))
        + curve["bright"] * F.pow(bright, F.lit(curve["bright_gamma"]))
    )
    level = F.floor(clip(F.round(bent, 9), 0, 255)).cast("double")
    return (
        at.withColumn(out, F.when(F.col(mask), F.coalesce(level, F.lit(0.0))).otherwise(0.0))
        .drop(*spec, "_res", "_mid", "_lo", "_hi")
    )


def flatten(df: DataFrame, value: str, background: str, mask: str, mode: str, out: str) -> DataFrame:
    """Remove a background estimate.

    ``subtract``: difference above its masked p1; ``divide``: quotient times 128;
    ``divide_median``: quotient times the image's masked median. The first two
    are whole numbers 0..255 and zero outside the mask.
    """
    v, bg = F.col(value), F.col(background)
    whole = lambda c: F.floor(clip(F.round(c, 9), 0, 255)).cast("double")
    if mode == "divide":
        return df.withColumn(
            out, F.when(F.col(mask), whole(v / F.greatest(bg, F.lit(1.0)) * 128.0)).otherwise(0.0)
        )
    if mode == "subtract":
        rest = df.withColumn("_res", v - bg)
        at = with_stats(rest, {"_lo": (inside("_res", mask), 0.01)})
        level = whole(F.col("_res") - F.coalesce("_lo", F.lit(0.0)))
        return at.withColumn(out, F.when(F.col(mask), level).otherwise(0.0)).drop("_res", "_lo")
    if mode == "divide_median":
        at = with_stats(df, {"_med": (inside(value, mask), 0.5)})
        return at.withColumn(out, v * F.col("_med") / F.greatest(bg, F.lit(1.0))).drop("_med")
    raise ValueError(mode)


def enhance_light(
    df: DataFrame, rgb: tuple[str, str, str], mask: str, clip_limit: float = 2.5, tiles: tuple[int, int] = (8, 8), sigma: float = 1.2
) -> DataFrame:
    """Equalise and sharpen lightness only; hue stays. Adds ``enh_<channel>`` (0..255).

    Channels go to CIELAB, the lightness is equalised per tile and sharpened
    against its blur, and the triple goes back; outside the mask it is zero.
    """
    from cellgrove.operators.equalise import clahe
    from cellgrove.operators.filters import gaussian

    lab = rgb_to_lab(*[F.col(c) / 255.0 for c in rgb])
    split = df.withColumns({"_l": F.floor(lab["l"] * 2.55).cast("double"), "_a": lab["a"], "_b": lab["b"]})
    even = clahe(split, "_l", clip_limit, tiles, "_e")
    soft = gaussian(even, "_e", sigma, "reflect101", "_g")
    sharp = F.floor(clip(1.35 * F.col("_e") - 0.35 * F.col("_g"), 0, 255)) / 2.55
    back = lab_to_rgb(sharp, F.col("_a"), F.col("_b"))
    cols = {
        f"enh_{name}": F.when(F.col(mask), F.floor(back[k] * 255.0).cast("double")).otherwise(0.0)
        for name, k in zip(rgb, "rgb")
    }
    return soft.withColumns(cols).drop("_l", "_a", "_b", "_e", "_g")
