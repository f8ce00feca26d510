"""Smoothing, filter banks, local statistics and second-derivative responses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.functions.colour import clip
from cellgrove.operators.cells import with_stats
from cellgrove.operators.masked import inside, normalise
from cellgrove.operators.neighbourhood import correlate_many, separable
from cellgrove.operators.tiles import run


def gaussian(df: DataFrame, value: str, sigma: float, border: str, out: str, radius: int | None = None) -> DataFrame:
    return separable(df, value, K.gaussian_line(sigma, radius=radius), border, out)


def dark_scales(
    df: DataFrame, value: str, mask: str, groups: dict[str, tuple[float, ...]], smooth: float, border: str, out: str
) -> DataFrame:
    """How much darker a cell is than its surroundings, at several scales.

    Each scale's rectified difference is smoothed and scaled per image inside
    the mask. Every group of sigmas yields one column ``<out>_<group>``, its
    largest value per cell. All scales share one pass over tiles and one
    statistics pass.
    """
    sigmas = sorted({s for g in groups.values() for s in g})
    lines, line = [K.gaussian_line(s) for s in sigmas], K.gaussian_line(smooth)

    def chain(b):
        made, (values, known) = {}, b.layers[value]
        for i, wide in enumerate(lines):
            around, some = b.separable((values, known), wide, border)
            made[f"_e{i}"] = b.separable((np.maximum(around - values, 0.0), known & some), line, border)
        return made

    reach = max(abs(d) for wide in lines for d in wide) + max(abs(d) for d in line)
    soft = run(df, [value], reach, chain, {f"_e{i}": "" for i in range(len(sigmas))})
    spec, aggs = {}, {}
    for i in range(len(sigmas)):
        v = inside(f"_e{i}", mask)
        spec |= {f"_lo{i}": (v, 0.01), f"_hi{i}": (v, 0.99)}
        aggs |= {f"_mn{i}": F.min(v), f"_mx{i}": F.max(v)}
    at = with_stats(soft, spec, aggs)
    scaled = {}
    for i, s in enumerate(sigmas):
        spread = F.col(f"_hi{i}") > F.col(f"_lo{i}")
        low = F.when(spread, F.col(f"_lo{i}")).otherwise(F.col(f"_mn{i}"))
        high = F.when(spread, F.col(f"_hi{i}")).otherwise(F.col(f"_mx{i}"))
        unit = F.when(F.col(mask) & (high > low), clip((F.col(f"_e{i}") - low) / (high - low)))
        scaled[s] = F.coalesce(unit, F.lit(0.0))
    cols = {f"{out}_{g}": F.greatest(F.lit(0.0), *[scaled[s] for s in members]) for g, members in groups.items()}
    return at.withColumns(cols).drop(*spec, *aggs, *[f"_e{i}" for i in range(len(sigmas))])


def box(df: DataFrame, value: str, k: int, border: str, out: str) -> DataFrame:
    return separable(df, value, K.box_line(k), border, out)


def filter_bank_max(df: DataFrame, value: str, bank: list[K.Kernel], border: str, out: str, least: float = 0.0) -> DataFrame:
    """Largest response over a bank of kernels, all correlated in one pass."""
    names = [f"_k{i}" for i in range(len(bank))]
    responded = correlate_many(df, value, dict(zip(names, bank)), border)
    return responded.withColumn(out, F.greatest(F.lit(least), *names)).drop(*names)


# Fixed values: (sigma, wavelength) pairs and (size, sigma) pairs of the banks.
GABOR_SCALES = ((1.5, 3.0), (2.5, 5.0), (3.5, 7.0), (5.0, 10.0))
MATCHED_SCALES = ((9, 1.2), (15, 1.8), (21, 2.4), (31, 3.2))
MATCHED_FINE = ((5, 0.6), (7, 0.8), (9, 1.0))


def gabor_bank(scales=GABOR_SCALES, step: int = 15, gamma: float = 0.5) -> list[K.Kernel]:
    """Window six sigmas wide, made odd."""
    return [
        K.gabor(max(3, int(6 * s) | 1), s, angle, wavelength, gamma)
        for s, wavelength in scales
        for angle in range(0, 180, step)
    ]


def gabor_bank_by_wavelength(
    wavelengths=(8.0, 12.0, 16.0), sigma: float = 4.0, gamma: float = 0.5, step: int = 15, least: int = 17
) -> list[K.Kernel]:
    """Window 2.6 wavelengths wide, at least ``least``, made odd."""
    return [
        K.gabor(int(max(least, round(wl * 2.6))) | 1, sigma, angle, wl, gamma)
        for wl in wavelengths
        for angle in range(0, 180, step)
    ]


def matched_bank(scales=MATCHED_SCALES, step: int = 20) -> list[K.Kernel]:
    return [K.matched_line(k, s, a) for k, s in scales for a in range(0, 180, step)]


def dog_response(df: DataFrame, value: str, sigmas: tuple, ratio: float, border: str, out: str) -> DataFrame:
    """Largest rectified difference of Gaussians over a set of scales."""
    bank = [
        K.difference(K.gaussian(s), K.gaussian(s * ratio)) for s in sigmas
    ]
    return filter_bank_max(df, value, bank, border, out)


def focal_median(df: DataFrame, value: str, k: int, out: str, border: str = "replicate") -> DataFrame:
    """Median over a k x k window."""
    return run(df, [value], k // 2, lambda b: {out: b.median(b.layers[value], k, border)}, {out: ""})


def _local(df: DataFrame, value: str, windows: dict[int, tuple[str, str]], border: str) -> DataFrame:
    """Mean and population deviation under k x k windows, k -> (mean, std), in one pass over tiles."""
    names = [n for pair in windows.values() for n in pair]

    def chain(b):
        values, known = b.layers[value]
        made = {}
        for k, (mean, std) in windows.items():
            line = {d: 1.0 for d in range(-(k // 2), k - k // 2)}
            (s1, some), (s2, _) = (b.separable((v, known), line, border) for v in (values, values * values))
            m1, m2 = s1 / (k * k), s2 / (k * k)
            made[mean], made[std] = (m1, some), (np.sqrt(np.maximum(m2 - m1 * m1, 0.0)), some)
        return made

    return run(df, [value], max(k // 2 for k in windows), chain, dict.fromkeys(names, ""))


def local_std(df: DataFrame, value: str, k: int, out: str, border: str = "reflect") -> DataFrame:
    return _local(df, value, {k: ("_lm", out)}, border).drop("_lm")


def local_mean_std(df: DataFrame, value: str, k: int, mean: str, std: str, border: str = "reflect") -> DataFrame:
    return _local(df, value, {k: (mean, std)}, border)


def local_z(
    df: DataFrame, value: str, mask: str, scales: list[tuple[int, float, float]], out: str, border: str = "reflect"
) -> DataFrame:
    """How far below its surroundings a cell is, in local deviations, capped to [0, 1].

    ``scales`` are (window, least deviation, cap); the largest score counts.
    """
    windows = {k: (f"_m{k}", f"_d{k}") for k, _, _ in scales}
    df = _local(df, value, windows, border)
    dark = lambda k: F.greatest(F.col(f"_m{k}") - F.col(value), F.lit(0.0))
    scores = [clip(dark(k) / F.greatest(F.col(f"_d{k}"), F.lit(least)) / cap) for k, least, cap in scales]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    temps = [n for pair in windows.values() for n in pair]
    return df.withColumn(out, F.when(F.col(mask), best).otherwise(0.0)).drop(*temps)


def noise_maps(df: DataFrame, value: str, sigma: float, k: int, border: str = "reflect") -> DataFrame:
    """High-frequency residual against a Gaussian, and residual against a median."""
    line = K.gaussian_line(sigma)
    chain = lambda b: {"_g": b.separable(b.layers[value], line, border), "_md": b.median(b.layers[value], k, "replicate")}
    medial = run(df, [value], max(k // 2, *line), chain, {"_g": "", "_md": ""})
    return medial.withColumns(
        {"high_frequency": F.abs(F.col(value) - F.col("_g")), "residual": F.abs(F.col(value) - F.col("_md"))}
    ).drop("_g", "_md")


def bilateral(
    df: DataFrame, value: str, d: int, sigma_color: float, sigma_space: float, out: str, border: str = "reflect101"
) -> DataFrame:
    """Edge-preserving smoothing over a disc of diameter d.

    Neighbours are weighed by distance and by difference from the cell's own value.
    """
    r = max(1, d // 2)
    taps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]

    def chain(b):
        values, known = b.layers[value]
        near, met = b.padded((values, known), r, r, border)
        n, m = values.shape[:2]
        top, bottom = np.zeros(values.shape), np.zeros(values.shape)
        for dy, dx in taps:
            at = np.s_[r + dy : r + dy + n, r + dx : r + dx + m]
            apart = near[at] - values
            w = met[at] * math.exp(-(dy * dy + dx * dx) / (2.0 * sigma_space**2)) * np.exp(-apart * apart / (2.0 * sigma_color**2))
            top += w * near[at]
            bottom += w
        return {out: (top / np.where(bottom > 0, bottom, 1.0), known)}

    return run(df, [value], r, chain, {out: ""})


def gradient(df: DataFrame, value: str, gx: str, gy: str, border: str = "reflect101") -> DataFrame:
    return correlate_many(df, value, {gx: K.sobel("x"), gy: K.sobel("y")}, border)


def coherence(
    df: DataFrame, value: str, sigma: float, out: str, border: str = "reflect101", radius: int | None = None
) -> DataFrame:
    """Structure-tensor coherence: eigenvalue gap over trace of the smoothed tensor."""
    window = K.gaussian(sigma, radius)
    sobel = [K.sobel("x"), K.sobel("y")]

    def chain(b):
        (gx, known), (gy, _) = b.correlate(b.layers[value], sobel, border)
        products = {"_jxx": gx * gx, "_jyy": gy * gy, "_jxy": gx * gy}
        return {n: b.correlate((p, known), [window], border)[0] for n, p in products.items()}

    reach = 1 + max(max(abs(y), abs(x)) for y, x in window)
    smooth = run(df, [value], reach, chain, dict.fromkeys(("_jxx", "_jyy", "_jxy"), ""))
    diff = F.col("_jxx") - F.col("_jyy")
    gap = F.sqrt(diff * diff + 4.0 * F.col("_jxy") * F.col("_jxy"))
    return smooth.withColumn(out, clip(gap / (F.col("_jxx") + F.col("_jyy") + 1e-6))).drop("_jxx", "_jyy", "_jxy")


def _eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Larger and smaller eigenvalue of [[a, b], [b, c]]."""
    half = (a + c) / 2.0
    root = F.sqrt(F.pow((a - c) / 2.0, F.lit(2.0)) + b * b)
    return half + root, half - root


def hessian_eigenvalues(
    df: DataFrame, value: str, sigmas: tuple, border: str = "reflect", radius: int | None = None
) -> DataFrame:
    """Eigenvalue columns ``_hi{i}`` and ``_lo{i}`` per scale, all scales in one pass."""
    ker = {}
    for i, s in enumerate(sigmas):
        ker[f"_yy{i}"] = K.gaussian_derivative(s, 2, 0, radius)
        ker[f"_xy{i}"] = K.gaussian_derivative(s, 1, 1, radius)
        ker[f"_xx{i}"] = K.gaussian_derivative(s, 0, 2, radius)
    out = correlate_many(df, value, ker, border)
    cols = {}
    for i in range(len(sigmas)):
        cols[f"_hi{i}"], cols[f"_lo{i}"] = _eigenvalues(F.col(f"_yy{i}"), F.col(f"_xy{i}"), F.col(f"_xx{i}"))
    return out.withColumns(cols).drop(*ker)


def hessian_response(
    df: DataFrame,
    value: str,
    sigmas: tuple,
    method: str,
    mask: str,
    out: str,
    border: str = "reflect",
    radius: int | None = None,
    tau: float = 0.90,
    beta: float = 0.5,
) -> DataFrame:
    """Response to bright lines, scaled per image.

    ``jerman``: strength over its p99 with a blob penalty. ``jerman_smooth``:
    strength over tau * p99.5 through a smooth step. ``frangi``, ``sato`` and
    ``meijering`` follow their published definitions.
    """
    n = range(len(sigmas))
    eig = hessian_eigenvalues(df, value, sigmas, border, radius)
    m = F.col(mask)
    strength = lambda i: -F.col(f"_lo{i}")
    spec, aggs = {}, {}
    for i in n:
        s = F.when(m & (strength(i) > 0), strength(i))
        if method == "jerman":
            spec[f"_t{i}"] = (s, 0.99)
        elif method == "jerman_smooth":
            spec[f"_t{i}"] = (s, 0.995)
        elif method == "frangi":
            norm = F.sqrt(F.col(f"_hi{i}") * F.col(f"_hi{i}") + F.col(f"_lo{i}") * F.col(f"_lo{i}"))
            aggs[f"_t{i}"] = F.max(norm * float(sigmas[i] ** 2))
        elif method == "meijering":
            aggs[f"_t{i}"] = F.max(_neurite(i))
    if spec or aggs:
        eig = with_stats(eig, spec, aggs)
    per_scale = []
    for i in n:
        s, other, top = strength(i), F.col(f"_hi{i}"), F.col(f"_t{i}") / 2.0 if method == "frangi" else F.col(f"_t{i}")
        penalty = F.exp(-(other * other) / (2.0 * (s * s + 1e-6)))
        if method == "jerman":
            r = F.when((s > 0) & (top > 0), clip(s / top) * penalty)
        elif method == "jerman_smooth":
            rho = clip(s / (F.lit(tau) * top))
            r = F.when((s > 0) & (top > 0) & m, rho * rho * (3.0 - 2.0 * rho) * penalty)
        elif method == "frangi":
            big = F.abs(F.col(f"_lo{i}")) >= F.abs(other)
            l1 = F.when(big, other).otherwise(F.col(f"_lo{i}")) * float(sigmas[i] ** 2)
            l2 = F.when(big, F.col(f"_lo{i}")).otherwise(other) * float(sigmas[i] ** 2)
            blob = F.exp(-F.pow(l1 / l2, F.lit(2.0)) / (2.0 * beta**2))
            texture = 1.0 - F.exp(-(l1 * l1 + l2 * l2) / (2.0 * top * top))
            r = F.when((l2 < 0) & (top > 0), blob * texture)
        elif method == "sato":
            r = F.greatest(s, F.lit(0.0)) * float(sigmas[i] ** 2)
        elif method == "meijering":
            r = F.when(top > 0, _neurite(i) / top)
        else:
            raise ValueError(method)
        per_scale.append(F.coalesce(r, F.lit(0.0)))
    best = F.greatest(F.lit(0.0), *per_scale)
    scored = eig.withColumn("_resp", F.when(m, best).otherwise(0.0))
    temps = [c for c in scored.columns if c.startswith(("_hi", "_lo", "_t"))]
    return normalise(scored.drop(*temps), "_resp", mask, out).drop("_resp")


def _neurite(i: int) -> Column:
    """Modified eigenvalue of largest magnitude, kept where it marks a bright line."""
    a, b = F.col(f"_hi{i}"), F.col(f"_lo{i}")
    x, y = a + b / 3.0, b + a / 3.0
    dominant = F.when(F.abs(x) > F.abs(y), x).otherwise(y)
    return F.greatest(-dominant, F.lit(0.0))
