"""Recipe runner and presets (section R) over the 8 x 8 rasters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import U8, pick, rounded, u8_cells
from cellgrove.catalog.scalars import FUSED
from cellgrove.operators.bridging import connect_ends
from cellgrove.operators.cells import bound
from cellgrove.plans import presets as P
from cellgrove.plans.recipe import run_recipe, run_variants, step


def photo(read):
    """Green and lightness channels of each raster, and a red and blue derived from them."""
    v = F.col("v8")
    return u8_cells(read).select(
        "image_id",
        "h",
        "w",
        "y",
        "x",
        "fov",
        v.alias("green"),
        F.floor(v * 0.8 + 20.0).cast("double").alias("light"),
        F.floor(F.least(v * 1.1 + 10.0, F.lit(255.0))).cast("double").alias("red"),
        F.floor(v * 0.5).cast("double").alias("blue"),
    )


def maps(read):
    """Response, support and coherence columns for the mask presets."""
    n = F.col("n")
    return u8_cells(read).select(
        "image_id", "h", "w", "y", "x", "fov", n.alias("response"), ((n + 1.0 - n * n) / 2).alias("support"),
        (F.abs(n - 0.5) * 2).alias("coherence"),
    )


@query(
    "R1_run_recipe",
    f"""WITH {U8}, {FUSED} SELECT image_id, y, x, round(CASE WHEN e2.hi > e2.lo THEN least(greatest((m - e2.lo) / (e2.hi - e2.lo), 0.0), 1.0)
  WHEN e2.mx > e2.mn THEN least(greatest((m - e2.mn) / (e2.mx - e2.mn), 0.0), 1.0) ELSE 0.0 END, 6) AS fused
FROM mixed JOIN e2 USING (image_id)""",
)
def _(read):
    steps = [
        step("sql", "g", text="(1D - n) * n"),
        step("fuse", "fused", weights={"n": 0.65, "g": 0.35}, mask="fov"),
    ]
    return pick(run_recipe(u8_cells(read).select("image_id", "h", "w", "y", "x", "fov", "n"), steps, ["fused"]), "fused")


@query(
    "R1_run_variants",
    f"""WITH {U8}, t AS (SELECT image_id, quantile_cont(n, 0.84) FILTER (n > 0) AS a, quantile_cont(n, 0.9) FILTER (n > 0) AS b FROM u8 WHERE fov GROUP BY image_id)
SELECT image_id, y, x, 'wide' AS variant, fov AND n >= a AS mask FROM u8 JOIN t USING (image_id)
UNION ALL SELECT image_id, y, x, 'narrow', fov AND n >= b FROM u8 JOIN t USING (image_id)""",
)
def _(read):
    make = lambda d: [step("threshold", "mask", value="n", mask="fov", method="percentile", density=d)]
    base = u8_cells(read).select("image_id", "h", "w", "y", "x", "fov", "n")
    out = run_variants(base, {"wide": make(0.16), "narrow": make(0.10)}, ["mask"])
    return out.select("image_id", "y", "x", "variant", "mask")


@query("P1_build_channels")
def _(read):
    return pick(P.build_channels(photo(read), "maps", P.SMALL), "c0", "c1", "c2")


@query(
    "P1_build_channels_rgb",
    f"""WITH {U8}, ch AS (SELECT image_id, y, x, fov, floor(least(v8 * 1.1 + 10.0, 255.0)) AS r, v8 AS g, floor(v8 * 0.5) AS b FROM u8),
e AS (SELECT image_id, {', '.join(f'quantile_cont({c}, 0.01) AS {c}l, greatest(quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01), 1e-8) AS {c}h' for c in 'rgb')} FROM ch WHERE fov GROUP BY image_id)
SELECT image_id, y, x, {', '.join(f'CASE WHEN fov THEN floor(least(greatest(({c} - {c}l) / {c}h, 0.0), 1.0) * 255.0) ELSE 0.0 END AS c{i}' for i, c in enumerate('rgb'))} FROM ch JOIN e USING (image_id)""",
)
def _(read):
    return pick(P.build_channels(photo(read), "rgb"), "c0", "c1", "c2")


@query("P2_run_sources")
def _(read):
    out = P.run_sources(photo(read), z=P.SMALL)
    return rounded(out.select("image_id", "y", "x", "variant", "source", "combined"))


@query("P2_fuse_sources")
def _(read):
    return pick(P.fuse_sources(photo(read), {"C6G6": 0.6, "FlatSub+G6": 0.4}, P.SMALL), "combined")


@query("P2_fuse_maps")
def _(read):
    return pick(P.fuse_maps(photo(read), P.SMALL), "map_c6", "map_flat", "map_green", "combined")


@query("P3_boost_dark")
def _(read):
    return pick(run_recipe(photo(read), P.boost_dark(P.SMALL), ["boosted"]), "boosted")


@query("P3_suppress_bright")
def _(read):
    return pick(run_recipe(photo(read), P.suppress_bright(P.SMALL), ["calm"]), "calm")


@query("P4_assemble_responses")
def _(read):
    keep = ["response", "support", "coherence", "mask_clean"]
    return pick(run_recipe(photo(read), P.assemble_responses(P.SMALL), keep), *keep)


@query("P4_reduced_responses")
def _(read):
    keep = ["response", "support", "coherence"]
    return pick(run_recipe(photo(read), P.reduced_responses(P.SMALL), keep), *keep)


@query("P4_response_variants")
def _(read):
    out = P.response_variants(maps(read), P.SMALL)
    return rounded(out.select("image_id", "y", "x", "variant", "cond", "mask"))


@query("P5_soft_response")
def _(read):
    return pick(run_recipe(photo(read), P.soft_response(P.SMALL), ["soft"]), "soft")


@query("P6_segment")
def _(read):
    soft = u8_cells(read).select("image_id", "h", "w", "y", "x", "fov", F.col("n").alias("soft"), (~F.col("fov")).alias("outline"))
    cfg = {**P.SEGMENT, "recovery_axis_ratio": 1.3, "recovery_skeleton_length": 2, "recovery_branch_density": 0.5}
    return pick(run_recipe(soft, P.segment(cfg, recover_area=2), ["first_mask", "mask_final"]), "first_mask", "mask_final")


@query("P7_mask_variants")
def _(read):
    return P.mask_variants(maps(read), P.SMALL).select("image_id", "y", "x", "variant", "mask")


@query("P8_fine_branch")
def _(read):
    df = maps(read).withColumnsRenamed({"response": "top_hat", "support": "matched"})
    return pick(run_recipe(df, P.fine_branch(P.SMALL), ["fine_response", "fine_mask", "fine_lines"]), "fine_response", "fine_mask", "fine_lines")


for _query, _name in (("P9_seed_mask", "path"), ("P9_seed_mask_plain", "plain"), ("P9_seed_mask_balanced", "balanced")):

    @query(_query)
    def _(read, name=_name):
        return pick(run_recipe(maps(read), P.seed_mask(name, P.SMALL), ["seed_mask"]), "seed_mask")


@query("P7_connect_ends")
def _(read):
    df = maps(read).withColumn("m", F.col("fov") & (F.col("response") > 0.7))
    return pick(connect_ends(df, "m", "response", "support", "fov", "connected", max_gap=5), "connected")


def mosaic(df, side=8):
    """Rasters of side x side small ones each, from neighbouring image numbers; an incomplete last row is left dark."""
    number = F.col("image_id") % (side * side)
    y, x = F.floor(number / side) * 8 + F.col("y"), number % side * 8 + F.col("x")
    return df.select(
        F.floor(F.col("image_id") / (side * side)).alias("image_id"), F.lit(8 * side).alias("h", metadata=bound(8 * side, 8 * side)),
        F.lit(8 * side).alias("w"),
        y.cast("int").alias("y"), x.cast("int").alias("x"), *[c for c in df.columns if c not in ("image_id", "h", "w", "y", "x")],
    )


@query("P1_build_channels_full_sizes")
def _(read):
    return pick(P.build_channels(mosaic(photo(read)), "maps", P.FULL), "c0", "c1", "c2")


#: Mosaics of 64 x 64 are too small for the full erosion of 35 cells.
DISC = replace(P.FULL, disc_erode=3)


@query("P4_disc_circles")
def _(read):
    return rounded(P.disc_circles(mosaic(photo(read)), z=DISC))


@query("P4_drop_disc")
def _(read):
    df = mosaic(photo(read)).withColumn("seg", F.col("fov") & (F.col("green") > 150))
    return P.drop_disc(df, "seg", "kept", z=DISC).select("image_id", "y", "x", "seg", "kept")


@query("P7_mask_variants_full_sizes")
def _(read):
    return P.mask_variants(mosaic(maps(read)), P.FULL).select("image_id", "y", "x", "variant", "mask")


@query(
    "P9_cost_surface",
    f"""WITH {U8} SELECT image_id, y, x, round(CASE WHEN fov THEN least(greatest(1 - least(greatest(0.46 * (n + 1.0 - n * n) / 2 + 0.36 * n + 0.18 * abs(n - 0.5) * 2, 0.0), 1.0), 0.05), 1.0) ELSE 8.0 END, 6) AS cost FROM u8""",
)
def _(read):
    return pick(run_recipe(maps(read), P.cost_surface(), ["cost"]), "cost")


@query("P10_rim_mask")
def _(read):
    return pick(run_recipe(photo(read), P.rim_mask(P.SMALL), ["rim"]), "rim")


@query("C3_enhance_light")
def _(read):
    from cellgrove.operators.contrast import enhance_light

    out = enhance_light(photo(read), ("red", "green", "blue"), "fov", tiles=P.SMALL.tiles_plain, sigma=0.8)
    return pick(out, "enh_red", "enh_green", "enh_blue")
