"""Named recipes. Each function returns steps; none adds an operator of its own.

Inputs are columns of the cell table: ``green`` and ``light`` (0..255), ``fov``.
``sizes`` holds the window sizes; ``FULL`` are the usual ones, ``SMALL`` suits
rasters of a few cells a side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.operators import filters as T
from cellgrove.operators.circles import circle_peaks, circle_votes, drop_at_circles, thin_edges
from cellgrove.plans.recipe import Step, run_recipe, run_variants, step
from cellgrove.session import cut


@dataclass(frozen=True)
class Sizes:
    tiles: tuple[int, int] = (16, 16)
    tiles_coarse: tuple[int, int] = (12, 12)
    tiles_plain: tuple[int, int] = (8, 8)
    median: int = 7
    gabor: tuple = T.GABOR_SCALES
    gabor_step: int = 15
    gabor_wave: tuple = (8.0, 12.0, 16.0)
    gabor_wave_sigma: float = 4.0
    gabor_wave_least: int = 17
    matched: tuple = T.MATCHED_SCALES
    matched_step: int = 20
    line: tuple = ((15, 2.0),)
    line_fine: tuple = ((9, 1.2),)
    line_step: int = 15
    hats: tuple = (5, 7, 9, 13, 17, 23, 31)
    hats_fine: tuple = (3, 5, 7)
    hat_close: int = 15
    ridge_line: int = 21
    ridge_angles: int = 12
    ridge_scales: tuple = (3.0, 5.0, 7.0, 9.0, 11.0)
    scales: tuple = (1.0, 2.0, 3.0, 4.0, 5.0)
    jerman: tuple = (1.0, 1.6, 2.4, 3.2, 4.8)
    jerman_wide: tuple = (1.0, 3.0, 5.0, 7.0)
    fine: tuple = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0)
    hessian_radius: int | None = None
    background: float = 30.0
    background_box: int = 30
    dark: tuple = (1.4, 2.2, 3.6, 5.5, 8.0)
    erode: int = 8
    min_area: int = 16
    border: int = 3
    edge_margin: int = 24
    disc_erode: int = 35
    fine_area: int = 25
    fine_length: int = 12
    outline: float = 26.0
    rim_search: int = 128
    rim_contact: int = 32
    rim_area: int = 10
    rim_grow: int = 3
    ramp: tuple = (6.0, 42.0)
    bins: int = 256
    shape_area: int = 28
    near_dark: float = 2.0
    least_area: int = 12
    #: Divisor of the areas of the mask variants, and their least value where it is not 1.
    area_share: int = 1
    tree_radius: int = 9
    least_values: int = 100
    local_window: int = 41
    #: Noise cleaning of the variants and of the seed masks: large area, reach, (area, length, ratio).
    noise: tuple = (35, 8, (12, 5, 1.9))
    seed_noise: tuple = (35, 8, (12, 5, 1.9))
    #: Area rule of the seed masks; None leaves each its own.
    seed_area: int | None = None


FULL = Sizes()
SMALL = Sizes(
    tiles=(2, 2), tiles_coarse=(2, 2), tiles_plain=(2, 2), median=3, gabor=((0.8, 3.0),), gabor_step=45,
    gabor_wave=(3.0,), gabor_wave_sigma=1.0, gabor_wave_least=5, matched=((5, 0.8),), matched_step=45, line=((5, 0.8),), line_fine=((3, 0.6),), line_step=45,
    hats=(3, 5), hats_fine=(3,), hat_close=3, ridge_line=5, ridge_angles=4, ridge_scales=(0.8,), scales=(0.7, 1.0),
    jerman=(0.7, 1.0), jerman_wide=(0.7, 1.0), fine=(0.5, 0.8), hessian_radius=2, background=1.5, background_box=4,
    dark=(0.6, 1.0), erode=0, min_area=2, border=1, edge_margin=1, fine_area=2, fine_length=1, outline=0.5,
    rim_search=3, rim_contact=1, rim_area=2, rim_grow=1, ramp=(0.5, 2.0), bins=32, shape_area=6,
    near_dark=0.8, least_area=3, area_share=5, tree_radius=2, least_values=20, local_window=5,
    noise=(7, 2, (2, 3, 1.9)), seed_noise=(6, 2, (4, 3, 1.9)), seed_area=3,
)


def _zero(col: str, out: str, mask: str = "fov") -> Step:
    return step("sql", out, text=f"if({mask}, {col}, 0D)")


def _u8(col: str, out: str, mask: str = "fov") -> Step:
    return step("sql", out, text=f"if({mask}, floor(least(greatest({col}, 0D), 1D) * 255D), 0D) * 1D")


def ridge_source(z: Sizes) -> list[Step]:
    return [
        _zero("green", "gm"),
        step("clahe", "rs8", value="gm", clip_limit=4.0, tiles=z.tiles),
        _zero("rs8", "rsz"),
        step("normalise", "ridge_green", value="rsz", mask="fov", variant="floor"),
    ]


def vessel_channel(z: Sizes) -> list[Step]:
    """Equalise, invert, Gabor bank, median, equalise again."""
    return [
        _zero("green", "gm"),
        step("clahe", "e8", value="gm", clip_limit=6.0, tiles=z.tiles),
        step("sql", "inv", text="if(fov, 255D - e8, 255D)"),
        step("normalise", "invn", value="inv", mask="fov", variant="floor"),
        step("bank", "gr", value="invn", bank=T.gabor_bank(z.gabor, z.gabor_step), border="reflect"),
        _zero("gr", "gz"),
        step("normalise", "gn", value="gz", mask="fov", variant="floor"),
        _u8("gn", "g8"),
        step("median", "gmed", value="g8", k=z.median),
        _zero("gmed", "gmz"),
        step("normalise", "soft", value="gmz", mask="fov", variant="floor"),
        _u8("soft", "s8"),
        step("clahe", "sharp8", value="s8", clip_limit=12.0, tiles=z.tiles_coarse),
        _zero("sharp8", "sharpz"),
        step("normalise", "vessel", value="sharpz", mask="fov", variant="floor"),
    ]


def ridge_channel(z: Sizes) -> list[Step]:
    """0.6 second-derivative response + 0.4 oriented top-hat of the equalised green."""
    lines = [K.line_element(z.ridge_line, 180.0 * i / z.ridge_angles) for i in range(z.ridge_angles)]
    return [
        *ridge_source(z),
        step("hessian", "hr", value="ridge_green", sigmas=z.ridge_scales, method="meijering", mask="fov", radius=z.hessian_radius),
        _u8("ridge_green", "rg8"),
        step("tophat", "ot", value="rg8", elements=lines),
        _zero("ot", "otz"),
        step("normalise", "otn", value="otz", mask="fov", variant="floor"),
        step("fuse", "ridge", weights={"hr": 0.6, "otn": 0.4}, mask="fov"),
    ]


def build_channels(df: DataFrame, mode: str = "maps", z: Sizes = FULL) -> DataFrame:
    """P1. Three 0..255 channels: vessel, ridge and equalised green, or masked RGB."""
    if mode == "maps":
        steps = [*vessel_channel(z), *ridge_channel(z)]
        steps += [_u8("vessel", "c0"), _u8("ridge", "c1"), _u8("ridge_green", "c2")]
    elif mode == "rgb":
        steps = []
        for i, c in enumerate(("red", "green", "blue")):
            steps += [_zero(c, f"{c}z"), step("normalise", f"{c}n", value=f"{c}z", mask="fov", variant="floor"), _u8(f"{c}n", f"c{i}")]
    else:
        raise ValueError(mode)
    return run_recipe(df, steps, ["fov", "c0", "c1", "c2"])


def _green_clahe(clip: float, z: Sizes, out: str) -> list[Step]:
    return [step("clahe", f"{out}_raw", value="green", clip_limit=clip, tiles=z.tiles_plain), _zero(f"{out}_raw", out)]


def source_recipe(name: str, z: Sizes = FULL, out: str = "source") -> list[Step]:
    """P2. Steps of one named channel source."""
    g6 = _green_clahe(6.0, z, "g6")
    hat = K.ellipse(z.hat_close)
    stretch = lambda col, o: step("sql", o, text=f"if(fov, {col}, 0D)")
    if name == "C4G4":
        return _green_clahe(4.0, z, out)
    if name == "C6G6":
        return _green_clahe(6.0, z, out)
    if name == "BH isolated":
        return [
            *g6,
            step("blackhat", "bh", value="g6", elements=[hat]),
            stretch("bh", "bhz"),
            step("stretch", out, value="bhz", mask="fov", lo=0.05, hi=1.0),
        ]
    if name == "BHboost+G6":
        return [
            *g6,
            step("blackhat", "bh", value="g6", elements=[hat]),
            step("stretch", "bh8", value="bh", mask="fov", lo=0.0, hi=1.0),
            step("sql", "boosted", text="if(fov, floor(least(g6 + 1.25D * bh8, 255D)), 0D) * 1D"),
            step("clahe", "boost_eq", value="boosted", clip_limit=6.0, tiles=z.tiles_plain),
            stretch("boost_eq", out),
        ]
    if name in ("FlatSub+G6", "FlatDiv+G6"):
        return [
            *g6,
            step("fill_median", "g6f", value="g6", mask="fov"),
            step("gaussian", "bg", value="g6f", sigma=z.background, border="reflect101"),
            step("flatten", "flat", value="g6f", background="bg", mask="fov", mode="subtract" if "Sub" in name else "divide"),
            step("clahe", "flat_eq", value="flat", clip_limit=6.0, tiles=z.tiles),
            stretch("flat_eq", out),
        ]
    if name == "default":
        steps = [
            step("clahe", "eq0", value="green", clip_limit=2.5, tiles=z.tiles_plain),
            stretch("eq0", "eq"),
            step("fill_median", "eqf", value="eq", mask="fov"),
            step("bilateral", "bf", value="eqf", d=5, sigma_color=40.0, sigma_space=2.0),
            step("box", "bg", value="bf", k=z.background_box, border="reflect"),
        ]
        inner = "fov"
        if z.erode:
            steps.append(step("erode", "inner", value="fov", element=K.ellipse(2 * z.erode + 1)))
            inner = "inner"
        return [*steps, step("contrast", out, value="bf", background="bg", mask="fov", stats_mask=inner)]
    raise ValueError(name)


SOURCES = ("default", "C4G4", "C6G6", "BH isolated", "BHboost+G6", "FlatSub+G6", "FlatDiv+G6")


def filter_stack(z: Sizes, source: str = "source", out: str = "combined") -> list[Step]:
    """Invert a source, run the line filters and fuse them."""
    return [
        step("sql", "inv8", text=f"255D - {source}"),
        step("normalise", "invn", value="inv8", mask="fov"),
        step("tophat", "th", value="inv8", elements=[K.ellipse(k) for k in z.hats]),
        step("gaussian", "ths", value="th", sigma=0.8, border="reflect101"),
        step("normalise", "top_hat", value="ths", mask="fov"),
        step("bank", "mr", value="invn", bank=T.matched_bank(z.matched, z.matched_step), border="reflect"),
        _zero("mr", "mz"),
        step("normalise", "matched", value="mz", mask="fov"),
        step("hessian", "frangi", value="invn", sigmas=z.scales, method="frangi", mask="fov", radius=z.hessian_radius),
        step("hessian", "jerman", value="invn", sigmas=z.jerman, method="jerman", mask="fov", radius=z.hessian_radius),
        step("fuse", "mix", weights={"top_hat": 0.20, "matched": 0.40, "frangi": 0.15, "jerman": 0.25}, mask="fov", scale=False),
        step("gaussian", "mixs", value="mix", sigma=0.6, border="reflect101"),
        _zero("mixs", "mixz"),
        step("normalise", out, value="mixz", mask="fov"),
    ]


def run_sources(df: DataFrame, names=SOURCES, z: Sizes = FULL) -> DataFrame:
    """P2. Fused response of every named source, one variant each."""
    recipes = {n: [*source_recipe(n, z), *filter_stack(z)] for n in names}
    return run_variants(df, recipes, ["fov", "source", "combined"])


def fuse_sources(df: DataFrame, weights: dict[str, float], z: Sizes = FULL) -> DataFrame:
    """P2. Weighted mean of the inverted sources, then the filter stack once."""
    steps: list[Step] = []
    for i, name in enumerate(weights):
        steps += source_recipe(name, z, f"src{i}")
        steps += [step("sql", f"i{i}", text=f"255D - src{i}"), step("normalise", f"n{i}", value=f"i{i}", mask="fov")]
    total = sum(weights.values())
    mean = " + ".join(f"{w / total!r}D * n{i}" for i, w in enumerate(weights.values()))
    steps += [step("sql", "source", text=f"if(fov, 255D - floor(255D * ({mean})), 255D) * 1D")]
    return run_recipe(df, [*steps, *filter_stack(z)], ["fov", "source", "combined"])


def green_maps(z: Sizes = FULL, out: str = "combined") -> list[Step]:
    """P2. Matched lines and ridges of the equalised green channel alone."""
    return [
        *_green_clahe(2.5, z, "ge"),
        step("sql", "ginv", text="if(fov, 255D - floor(ge), 255D)"),
        step("normalise", "gn", value="ginv", mask="fov"),
        step("bank", "gm0", value="gn", bank=T.matched_bank(z.matched, z.matched_step), border="reflect"),
        _zero("gm0", "gmz"),
        step("normalise", "gmatched", value="gmz", mask="fov"),
        step("hessian", "gjerman", value="gn", sigmas=z.jerman, method="jerman", mask="fov", radius=z.hessian_radius),
        step("fuse", "gmix", weights={"gmatched": 0.6, "gjerman": 0.4}, mask="fov", scale=False),
        step("normalise", out, value="gmix", mask="fov"),
    ]


def fuse_maps(df: DataFrame, z: Sizes = FULL) -> DataFrame:
    """P2. Whole filter stacks of two sources and the plain green maps, fused as maps."""
    keep = [c for c in df.columns if c not in ("image_id", "h", "w", "y", "x")]
    maps = {"map_c6": "C6G6", "map_flat": "FlatSub+G6"}
    for name, source in maps.items():
        df = cut(run_recipe(df, [*source_recipe(source, z), *filter_stack(z, out=name)], [*keep, name]))
        keep.append(name)
    steps = [
        *green_maps(z, "map_green"),
        # fixed values
        step("fuse", "mapmix", weights={"map_c6": 0.45, "map_flat": 0.35, "map_green": 0.20}, mask="fov", scale=False),
        step("normalise", "combined", value="mapmix", mask="fov"),
    ]
    return run_recipe(df, steps, ["fov", "map_c6", "map_flat", "map_green", "combined"])


def boost_dark(z: Sizes = FULL, source: str = "green", out: str = "boosted") -> list[Step]:
    """P3. Flatten, deepen small dark structures found at several scales, stretch."""
    steps = [
        step("fill_median", "bf", value=source, mask="fov"),
        step("gaussian", "bbg", value="bf", sigma=z.background, border="reflect101"),
        step("flatten", "bflat", value="bf", background="bbg", mask="fov", mode="divide_median"),
    ]
    groups = {"near": (z.near_dark,), "many": z.dark}
    steps += [
        step("dark_scales", "dk", value="bflat", mask="fov", groups=groups, smooth=0.35, border="reflect101"),
        _u8("dk_many", "multi8"),
        step("median", "multim", value="multi8", k=3),
        step("sql", "multiz", text="if(fov, multim / 255D, 0D)"),
        step("fuse", "vb", weights={"dk_near": 0.35, "multiz": 0.65}, mask="fov"),
        step("sql", "deep", text="bflat - 42D * vb"),
        step("gaussian", "deeps", value="deep", sigma=0.25, border="reflect101"),
        step("stretch", out, value="deeps", mask="fov", lo=0.007, hi=0.993),
    ]
    return steps


def suppress_bright(z: Sizes = FULL, source: str = "green", out: str = "calm") -> list[Step]:
    """P3. Replace spots that are bright in lightness and in the channel by a smooth fill."""
    return [
        step("fill_median", "sf", value=source, mask="fov"),
        step("active_mask", "lit", value="light", mask="fov", p=0.98),
        step("active_mask", "hot", value="sf", mask="fov", p=0.95),
        step("sql", "spot", text="lit and hot"),
        step("dilate", "spots", value="spot", element=K.ellipse(z.hat_close)),
        step("gaussian", "sg", value="sf", sigma=z.background / 2, border="reflect"),
        step("sql", out, text="if(fov, floor(if(spots, sg, sf)), 0D) * 1D"),
    ]


def assemble_responses(z: Sizes = FULL) -> list[Step]:
    """P4. Source to evidence-gated mask (columns response, support, coherence, mask_clean)."""
    bank = T.matched_bank(z.line, z.line_step)
    hats = [K.ellipse(k) for k in z.hats_fine]
    return [
        step("fill_nearest", "gf", value="green", mask="fov"),
        step("box", "gbg", value="gf", k=z.background_box, border="reflect"),
        step("flatten", "gflat", value="gf", background="gbg", mask="fov", mode="divide_median"),
        step("normalise", "gnorm", value="gflat", mask="fov", lo=0.005, hi=0.995),
        step("sql", "source", text="if(fov, floor(32D + 223D * gnorm), 0D) * 1D"),
        step("sql", "inv8", text="if(fov, 255D - source, 0D)"),
        step("normalise", "base", value="inv8", mask="fov", variant="masked"),
        step("fill_median", "basef", value="base", mask="fov"),
        step("bank", "lr", value="basef", bank=bank, border="reflect"),
        step("normalise", "matched", value="lr", mask="fov", variant="masked"),
        _u8("matched", "m8"),
        step("tophat", "th", value="m8", elements=hats, combine="mean"),
        step("normalise", "top_hat", value="th", mask="fov", variant="masked"),
        step("fill_median", "thf", value="top_hat", mask="fov"),
        step("hessian", "frangi", value="thf", sigmas=z.jerman_wide, method="frangi", mask="fov", radius=z.hessian_radius, beta=15.0),
        step("hessian", "jerman", value="thf", sigmas=z.jerman_wide, method="jerman_smooth", mask="fov", radius=z.hessian_radius),
        step("fuse", "response", weights={"frangi": 0.70, "jerman": 0.30}, mask="fov"),
        step("edge_distance", "edge", mask="fov"),
        step("sql", "ramp", text=f"if(fov, least(greatest((edge - {z.ramp[0]}D) / {z.ramp[1]}D, 0D), 1D), 0D)"),
        step("sql", "prob0", text="(0.78D * response + 0.12D * matched + 0.10D * top_hat) * ramp"),
        step("normalise", "prob", value="prob0", mask="fov", variant="masked"),
        step("fuse", "evidence", weights={"matched": 0.25, "top_hat": 0.15, "frangi": 0.30, "jerman": 0.30}, mask="fov"),
        step("evidence_hysteresis", "linked", value="prob", evidence="evidence", mask="fov"),
        step("shape_clean", "mask_clean", mask="linked", area=z.shape_area, small_area=5, ratio=1.8, length=4),
        step("coherence", "coh0", value="source", sigma=1.4),
        _zero("coh0", "coherence"),
        step("sql", "support", text="top_hat"),
    ]


def reduced_responses(z: Sizes = FULL, simple: bool = True) -> list[Step]:
    """P4. The variant without local z-scores: dark base, two line banks, gated support."""
    w = (0.46, 0.26, 0.20, 0.08) if simple else (0.44, 0.26, 0.22, 0.08)
    sw = (0.45, 0.25, 0.22, 0.08) if simple else (0.43, 0.25, 0.24, 0.08)
    floor, gamma, strong, weak, rfloor = (0.46, 0.9, 0.88, 0.58, 0.50) if simple else (0.38, 0.8, 0.86, 0.54, 0.42)
    names = ("matched", "fine", "jerman", "jerman_fine")
    return [
        step("sql", "dark", text="if(fov, 255D - green, 0D)"),
        step("percentile_floor", "darkf", value="dark", mask="fov", lo=0.35, hi=0.992, gamma=0.95),
        step("normalise", "base", value="darkf", mask="fov", variant="masked"),
        step("bank", "mr", value="base", bank=T.matched_bank(z.line, z.line_step), border="reflect"),
        step("normalise", "matched", value="mr", mask="fov", variant="masked"),
        step("bank", "fr", value="base", bank=T.matched_bank(z.line_fine, z.line_step), border="reflect"),
        step("normalise", "fine", value="fr", mask="fov", variant="masked"),
        step("hessian", "jerman", value="base", sigmas=z.jerman_wide, method="jerman_smooth", mask="fov", radius=z.hessian_radius),
        step("hessian", "jerman_fine", value="base", sigmas=z.fine[:2], method="jerman_smooth", mask="fov", radius=z.hessian_radius),
        step("coherence", "coh0", value="green", sigma=1.4),
        step("percentile_floor", "coherence", value="coh0", mask="fov", lo=0.42, hi=0.98),
        step("fuse", "sraw0", weights=dict(zip(names, sw)), mask="fov"),
        step("percentile_floor", "sraw", value="sraw0", mask="fov", lo=floor, hi=0.99, gamma=gamma),
        step("support_mask", "smask", support="sraw", coherence="coherence", mask="fov", strong_p=strong, weak_p=weak),
        step("sql", "smaskd", text="cast(smask as double)"),
        step("gaussian", "softm", value="smaskd", sigma=0.75, border="reflect101"),
        step("sql", "sgate", text="sraw * least(greatest(0.08D + 0.92D * softm, 0D), 1D)"),
        step("percentile_floor", "support", value="sgate", mask="fov", lo=0.36, hi=0.991, gamma=0.95),
        step("fuse", "raw", weights=dict(zip(names, w)), mask="fov"),
        step("sql", "gated", text="raw * (0.16D + 0.84D * support) * (0.62D + 0.38D * coherence)"),
        _u8("gated", "gt8"),
        step("median", "gtm", value="gt8", k=3),
        step("gaussian", "gtg", value="gated", sigma=0.45, border="reflect101"),
        step("sql", "smooth0", text="0.55D * gated + 0.25D * gtm / 255D + 0.20D * gtg"),
        step("normalise", "smooth", value="smooth0", mask="fov", variant="masked"),
        step("percentile_floor", "response", value="smooth", mask="fov", lo=rfloor, hi=0.994, gamma=1.02),
    ]


MAPS = ["fov", "response", "support", "coherence"]


def response_variants(df: DataFrame, z: Sizes = FULL) -> DataFrame:
    """P4. Six conditionings of a response, each with its hysteresis mask.

    ``df`` has response, support, coherence and fov.
    """
    line = "support * coherence"
    conditioned = {
        "base": [step("sql", "cond", text="response")],
        "conditioned": [
            step("sql", "c0", text="response * (0.45D + 0.55D * support) * (0.65D + 0.35D * coherence)"),
            step("normalise", "cond", value="c0", mask="fov"),
        ],
        "adaptive": [
            step("noise_strength", "st", response="response", support="support", coherence="coherence", mask="fov"),
            step(
                "sql",
                "c0",
                text="response * (0.45D - 0.20D * st + (0.55D + 0.20D * st) * support) * (0.72D - 0.27D * st + (0.28D + 0.27D * st) * coherence)",
            ),
            # the floor moves from p42 to p54 with the noise strength
            step("percentile_floor", "f42", value="c0", mask="fov", lo=0.42, hi=0.992),
            step("percentile_floor", "f54", value="c0", mask="fov", lo=0.54, hi=0.992),
            step("sql", "c1", text="(1D - st) * f42 + st * f54"),
            step("normalise", "cond", value="c1", mask="fov"),
        ],
        "blob_suppressed": [
            step("suppress_blobs", "c0", response="response", support="support", coherence="coherence", mask="fov"),
            step("normalise", "cond", value="c0", mask="fov"),
        ],
        "agreement": [
            step("agreement", "agree", tests=[("response", 0.72), ("support", 0.55), ("support", 0.70), ("coherence", 0.70)], mask="fov"),
            step("sql", "c0", text="if(fov, response * (0.25D + 0.75D * agree), 0D)"),
            step("normalise", "cond", value="c0", mask="fov"),
        ],
        "line": [
            step("sql", "l0", text=line),
            step("normalise", "lg", value="l0", mask="fov"),
            step("sql", "c0", text="response * (0.18D + 0.82D * lg)"),
            step("percentile_floor", "c1", value="c0", mask="fov", lo=0.52, hi=0.992),
            step("normalise", "cond", value="c1", mask="fov"),
        ],
    }
    finish = step(
        "connected_levels", "mask", value="cond", mask="fov", high=0.97, low=0.87, area=z.least_area,
        support="support", support_floor=0.12,
    )
    return run_variants(df, {n: [*s, finish] for n, s in conditioned.items()}, ["fov", "cond", "mask"])


def soft_response(z: Sizes = FULL) -> list[Step]:
    """P5. Boost, equalise, invert, bank, median, equalise, blend, cut the outline."""
    return [
        _zero("green", "gz"),
        step("fill_nearest", "gnear", value="gz", mask="fov"),
        *boost_dark(z, "gnear", "boosted"),
        step("clahe", "q1", value="boosted", clip_limit=6.0, tiles=z.tiles),
        step("sql", "qi", text="if(fov, 255D - q1, 255D)"),
        step("fill_median", "qf", value="qi", mask="fov"),
        step("sql", "qs", text="floor(qf) / 255D"),
        step(
            "bank",
            "gb",
            value="qs",
            bank=T.gabor_bank_by_wavelength(z.gabor_wave, z.gabor_wave_sigma, step=z.gabor_step, least=z.gabor_wave_least),
            border="reflect",
        ),
        step("normalise", "gbn", value="gb", mask="fov", variant="masked"),
        _u8("gbn", "gb8"),
        step("median", "med", value="gb8", k=z.median),
        _zero("med", "medz"),
        step("clahe", "q2", value="medz", clip_limit=12.0, tiles=z.tiles_coarse),
        _zero("q2", "q2z"),
        step("normalise", "q2n", value="q2z", mask="fov", variant="masked"),
        step("normalise", "medn", value="medz", mask="fov", variant="masked"),
        step("fuse", "soft0", weights={"medn": 0.65, "q2n": 0.35}, mask="fov"),
        step("edge_distance", "edge", mask="fov"),
        step("sql", "outline", text=f"fov and edge <= {z.outline}D"),
        step("sql", "soft", text="if(fov and not outline, soft0, 0D)"),
    ]


# The tuned two-pass configuration.
SEGMENT = {
    "target_density": 0.115, "main_low_mult": 1.45, "main_high_mult": 0.60, "residual_enabled": True,
    "residual_low_mult": 1.10, "recovery_axis_ratio": 2.6, "recovery_skeleton_length": 18, "recovery_branch_density": 0.10,
}


def segment(cfg: dict = SEGMENT, soft: str = "soft", recover_area: int | None = None) -> list[Step]:
    """P6. Hysteresis, two largest, close; then the same on what is left, and their union.

    The union is closed but not cut to the two largest again.
    """
    levels = {"low_mult": cfg["main_low_mult"], "high_mult": cfg["main_high_mult"]}
    steps = [
        step("density_hysteresis", "raw0", value=soft, mask="fov", density=cfg["target_density"], **levels),
        step("sql", "raw_mask", text="raw0 and not outline"),
        step("top_k", "two", mask="raw_mask", k=2),
        step("closing", "twoc", value="two", element=K.ellipse(3)),
        step("sql", "first_mask", text="twoc and fov and not outline"),
    ]
    if not cfg["residual_enabled"]:
        merged = "first_mask"
    else:
        steps += [
            step("dilate", "block", value="first_mask", element=K.ellipse(5)),
            step("sql", "rest", text="fov and not block and not outline"),
            step("sql", "rest0", text=f"if(rest, {soft}, 0D)"),
            step("normalise", "rest_soft", value="rest0", mask="rest", variant="masked"),
            step(
                "density_hysteresis", "cand", value="rest_soft", mask="rest",
                density=cfg["target_density"] * cfg["residual_low_mult"], **levels,
            ),
            step(
                "recover", "recovered", candidates="cand", response="rest_soft", mask="rest", ratio=cfg["recovery_axis_ratio"],
                length=cfg["recovery_skeleton_length"], branch_density=cfg["recovery_branch_density"], area=recover_area,
            ),
            step("top_k", "two2", mask="recovered", k=2),
            step("sql", "merged", text="(first_mask or two2) and fov and not outline"),
        ]
        merged = "merged"
    return [
        *steps,
        step("closing", "mergedc", value=merged, element=K.ellipse(3)),
        step("sql", "mask_final", text="mergedc and fov and not outline"),
    ]


def mask_variants(df: DataFrame, z: Sizes = FULL) -> DataFrame:
    """P7. Clean-up chains and threshold variants over response, support, coherence."""
    inner = [step("erode", "inner", value="fov", element=K.ellipse(2 * z.erode + 1))] if z.erode else [step("sql", "inner", text="fov")]
    levels = lambda hi, lo, area, floor: step(
        "connected_levels", "mask", value="response", mask="fov", high=hi, low=lo, area=area, support="support", support_floor=floor
    )
    a = lambda n: n if z.area_share == 1 else max(2, n // z.area_share)
    noise = dict(zip(("large", "near", "like"), z.noise))
    thin_levels = lambda rp, sp, r: [
        levels(0.97, 0.87, a(12), 0.12),
        step("sql", "seed", text="mask"),
        step("near_tree", "nt", seed="seed", response="support", support="support", coherence="coherence", fov="fov", response_p=rp, support_p=sp, radius=min(r, z.tree_radius)),
        step("sql", "mask", text="seed or nt"),
    ]
    recipes = {
        "clean_triangle": [
            *inner,
            step("threshold", "t", value="response", mask="inner", method="triangle", density=0.14, bins=z.bins),
            step("min_area", "t2", mask="t", n=z.min_area),
            step("drop_edge_lines", "mask", mask="t2", margin=z.edge_margin),
        ],
        "postprocess": [
            *inner,
            step("threshold", "t", value="response", mask="inner", method="percentile", density=0.10),
            step("min_area", "t2", mask="t", n=z.min_area),
            step("drop_border", "mask", mask="t2", band=z.border),
        ],
        "cleanup": [
            step("adaptive_hysteresis", "t", value="response", mask="fov", bins=z.bins, least=z.least_values),
            step("min_area", "t2", mask="t", n=a(8)),
            step("closing", "t3", value="t2", element=K.ellipse(5)),
            step("drop_border", "t4", mask="t3", band=z.border),
            step("sql", "mask", text="t4 and fov"),
        ],
        "elongated": [
            step("adaptive_hysteresis", "t", value="response", mask="fov", bins=z.bins, least=z.least_values),
            step("elongated", "mask", mask="t", aspect=2.0, area=a(8)),
        ],
        "elbow": [*inner, step("elbow_mask", "mask", value="response", mask="inner", least=z.least_values)],
        "top_k_close": [
            step("threshold", "t", value="response", mask="fov", method="percentile", density=0.16),
            step("top_k", "t2", mask="t", k=3),
            step("closing", "t3", value="t2", element=K.ellipse(5)),
            step("sql", "mask", text="t3 and fov"),
        ],
        "p94_shape": [step("active_mask", "t", value="response", mask="fov", p=0.94), step("shape_clean", "mask", mask="t", area=a(18))],
        "p97_shape": [step("active_mask", "t", value="response", mask="fov", p=0.97), step("shape_clean", "mask", mask="t", area=a(10))],
        "loose": [levels(0.96, 0.82, a(10), 0.08)],
        "balanced": [levels(0.97, 0.87, a(12), 0.12)],
        "strict": [levels(0.98, 0.91, a(18), 0.16)],
        "balanced_clean": [
            levels(0.97, 0.87, a(12), 0.12),
            step("sql", "seed", text="mask"),
            step("clean_noise", "mask", mask="seed", response="response", support="support", coherence="coherence", fov="fov", **noise),
        ],
        "near_tree": thin_levels(0.89, 0.45, 9),
        "near_tree_strict": thin_levels(0.92, 0.52, 8),
        "adaptive": [step("local_adaptive", "t", value="response", support="support", mask="fov", window=z.local_window), step("shape_clean", "mask", mask="t", area=a(14))],
        "response_support": [
            step("sql", "rs0", text="response * (0.40D + 0.60D * support)"),
            step("normalise", "rs", value="rs0", mask="fov"),
            step("connected_levels", "mask", value="rs", mask="fov", high=0.96, low=0.84, area=a(10), support="support", support_floor=0.10),
        ],
    }
    return run_variants(df, recipes, ["fov", "mask"])


def fine_branch(z: Sizes = FULL) -> list[Step]:
    """P8. Fine-scale response, triangle hysteresis, area rule, centre lines of some length."""
    return [
        step("hessian", "ff", value="top_hat", sigmas=z.fine, method="frangi", mask="fov", radius=z.hessian_radius, beta=15.0),
        step("hessian", "fj", value="top_hat", sigmas=z.fine, method="jerman_smooth", mask="fov", radius=z.hessian_radius),
        step("fuse", "fine_response", weights={"ff": 0.35, "fj": 0.45, "matched": 0.10, "top_hat": 0.10}, mask="fov"),
        step("triangle_hysteresis", "fh", value="fine_response", mask="fov", bins=8, ratio=0.70, strong_p=0.90, weak_p=0.78),
        step("min_area", "fine_mask", mask="fh", n=z.fine_area),
        step("thin", "fl", mask="fine_mask"),
        step("min_area", "fine_lines", mask="fl", n=z.fine_length),
    ]


# High, low, area, support floor, support percentile of the named masks.
SEED_MASKS = {
    "path": (0.955, 0.82, 10, 0.14, 0.32),
    "plain": (0.975, 0.90, 16, 0.14, 0.42),
    "balanced": (0.97, 0.87, 12, 0.12, 0.35),
}


def seed_mask(name: str = "path", z: Sizes = FULL) -> list[Step]:
    """P9. Gated hysteresis followed by noise cleaning."""
    hi, lo, area, floor, p = SEED_MASKS[name]
    large, near, like = z.seed_noise
    return [
        step(
            "connected_levels", "sm", value="response", mask="fov", high=hi, low=lo, area=z.seed_area or area,
            support="support", support_floor=floor, support_p=p,
        ),
        step(
            "clean_noise", "seed_mask", mask="sm", response="response", support="support", coherence="coherence", fov="fov",
            large=large, near=near, like=like,
        ),
    ]


COST = step(
    "sql", "cost",
    text="if(fov, least(greatest(1D - least(greatest(0.46D * support + 0.36D * response + 0.18D * coherence, 0D), 1D), 0.05D), 1D), 8D)",
)


def cost_surface() -> list[Step]:
    """P9. Cost of a path through each cell; high outside the field of view."""
    return [COST]


def rim_mask(z: Sizes = FULL) -> list[Step]:
    """P10. Strong lightness edges near the border whose components hug it."""
    near, contact = z.rim_search, z.rim_contact
    return [
        step("edge_distance", "edge", mask="fov"),
        step("sql", "band", text=f"fov and edge <= {near}D"),
        step("fill_nearest", "lf", value="light", mask="fov"),
        step("gradient", "grad", value="lf"),
        step("normalise", "gradn", value="grad", mask="band"),
        step("quantile_mask", "strongedge", value="gradn", mask="band", p=0.82, least=0.18),
        step("closing", "edgec", value="strongedge", element=K.ellipse(5)),
        step("hugging", "hug", mask="edgec", distance="edge", contact=float(contact), area=z.rim_area, mean=near * 0.40, peak=near * 0.90),
        step("dilate", "hugd", value="hug", element=K.ellipse(2 * z.rim_grow + 1)),
        step("sql", "rim", text="hugd and band and fov"),
    ]


def disc_circles(df: DataFrame, value: str = "red", z: Sizes = FULL, n: int = 8) -> DataFrame:
    """P4, P8. The best circles of the bright disc: edges of a band-passed red channel well inside the mask vote.

    Edge magnitudes are Euclidean. The result has one row for each image and rank.
    """
    steps = [
        step("edge_distance", "away", mask="fov"),
        step("sql", "inside", text=f"fov and away > {z.disc_erode}D"),
        step("sql", "dred", text=f"if(inside, {value}, 0D) * 1D"),
        step("gaussian", "dnear", value="dred", sigma=2.0, border="reflect101"),
        step("gaussian", "dwide", value="dred", sigma=8.0, border="reflect101"),
        step("sql", "dog", text="dnear - dwide"),
        step("normalise", "dogn", value="dog", mask="inside"),
        _u8("dogn", "dog8", "inside"),
        step("gradient", "dgrad", value="dog8"),
        step("normalise", "dgradn", value="dgrad", mask="inside"),
        _u8("dgradn", "dgrad8", "inside"),
    ]
    edges = cut(thin_edges(run_recipe(df, steps, ["dgrad8"]), "dgrad8", 40.0, 120.0))
    # fixed values: radii from 10 in steps of 4, below a third of the shorter side (at least 12) and 101
    below = F.least(F.lit(101), F.greatest(F.lit(12), F.floor(F.least("h", "w") / 3)))
    return circle_peaks(circle_votes(edges, list(range(10, 101, 4)), below=below), n)


def drop_disc(df: DataFrame, mask: str, out: str, value: str = "red", z: Sizes = FULL) -> DataFrame:
    """P4, P8. A segmentation without the compact blob at the best disc circle that has one."""
    dropped = drop_at_circles(df, mask, disc_circles(df, value, z), out)
    return dropped.withColumn(out, F.col(out) & F.col("fov"))
