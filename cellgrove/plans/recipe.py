"""Recipes: declared lists of operator steps run over a whole cell table.

A recipe is data. Each step names an operator, its output column and its
parameters; the runner chains the DataFrame operators, drops intermediate
columns once nothing reads them, and writes the table out when the steps since
the last write would otherwise read it too many times.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import components as P
from cellgrove.operators import contrast as X
from cellgrove.operators import equalise as Q
from cellgrove.operators import filters as T
from cellgrove.operators import masked as M
from cellgrove.operators import morphology as R
from cellgrove.operators import shapes as S
from cellgrove.operators import stacks
from cellgrove.operators import threshold as G
from cellgrove.operators.cells import GRID, settled, with_stats
from cellgrove.operators.distance import edge_distance, fill_nearest
from cellgrove.operators.quantiles import small_rasters
from cellgrove.operators.skeleton import reconnect, thin
from cellgrove.session import cut

#: Reads of the input a chain of steps may multiply to before it is written out.
READS = 6


@dataclass(frozen=True)
class Step:
    op: str
    out: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)


def step(op: str, out: str, **params) -> Step:
    return Step(op, out, params)


def _sql(df, out, text):
    return df.withColumn(out, F.expr(text))


def _labelled(df, mask, rule, out):
    lab = settled(P.label(df, mask, "_lab"))
    return rule(lab, out).drop("_lab")


def _shape_clean(df, out, mask, area, small_area=5, ratio=2.2, length=4):
    lab = P.label(thin(df, mask, "_sk"), mask, "_lab")
    return P.keep_where(lab, P.shape_rule(area, small_area, ratio, length, "_sk"), out, "_lab", counts=("_sk",)).drop("_sk", "_lab")


def _active_mask(df, out, value, mask, p):
    at = M.with_active(df, {"_ap": (value, p)}, mask)
    return at.withColumn(out, F.col(mask) & (F.col(value) >= F.col("_ap"))).drop("_ap")


def _adaptive_mask(df, out, value, mask, bins=256, least=100):
    at = M.join_stats(df, G.adaptive_levels(df, value, mask, bins, least))
    v, m = F.col(value), F.col(mask)
    marked = at.withColumns({"_st": m & (v >= F.col("high")), "_wk": m & (v >= F.col("low"))})
    return G.hysteresis(marked.drop("high", "low"), "_st", "_wk", out).drop("_st", "_wk")


def _elbow_mask(df, out, value, mask, lo=0.06, hi=0.16, least=100):
    """Threshold at the elbow density: rank of each image's value at that share."""
    share = G.elbow_density(df, value, mask, lo, hi, least).select("image_id", (1.0 - F.col("density")).alias("p"))
    levels = G.quantiles_at(df, F.when(F.col(value) > 0, M.inside(value, mask)), share, "_cut")
    return M.join_stats(df, levels).withColumn(out, F.col(mask) & (F.col(value) >= F.col("_cut"))).drop("_cut")


def _noise_strength(df, out, response, support, coherence, mask):
    return M.with_noise_strength(df, response, support, coherence, mask, out)


def _agree(df, out, tests, mask):
    """Share of signals at or above their own active percentile."""
    names = {f"_a{i}": (c, p) for i, (c, p) in enumerate(tests)}
    at = M.with_active(df, names, mask)
    checks = [F.col(c) >= F.col(n) for n, (c, _) in names.items()]
    return M.agreement(at, checks, out).drop(*names)


def _support_mask(df, out, support, coherence, mask, strong_p, weak_p):
    """Strong line support, and weak support linked to it, by shape rule."""
    at = M.with_active(df, {"_sp": (support, strong_p), "_wp": (support, weak_p), "_hp": (support, 0.78)}, mask)
    at = with_stats(at, {"_cf": (M.inside(coherence, mask), 0.35)})
    m, s = F.col(mask), F.col(support)
    lined = F.col(coherence) >= F.greatest(F.lit(0.04), F.col("_cf"))
    marked = settled(
        at.withColumns(
            {"_st": m & (s >= F.col("_sp")) & lined, "_wk": m & (s >= F.col("_wp")) & (lined | (s >= F.col("_hp")))}
        ).drop("_sp", "_wp", "_hp", "_cf")
    )
    clean = _shape_clean(marked, "_sc", "_st", 10, 4, 1.7)
    joined = settled(G.hysteresis(clean, "_sc", "_wk", "_hy", 4))
    return _shape_clean(joined, out, "_hy", 16, 5, 1.8).drop("_st", "_wk", "_sc", "_hy")


def _gradient(df, out, value):
    g = T.gradient(df, value, "_gx", "_gy")
    return g.withColumn(out, F.hypot("_gx", "_gy")).drop("_gx", "_gy")


def _quantile_mask(df, out, value, mask, p, least=0.0):
    """At or above the masked percentile, which is at least ``least``."""
    level = F.greatest(F.lit(least), F.col("_q"))
    return with_stats(df, {"_q": (M.inside(value, mask), p)}).withColumn(out, F.col(mask) & (F.col(value) >= level)).drop("_q")


def _hugging(df, out, mask, distance, contact, area, mean, peak):
    """Components that reach the border and stay close to it."""
    lab = P.label(df.withColumn("_touch", F.col(distance) <= contact), mask, "_lab")
    rule = (
        (F.col("area") >= area)
        & (F.col("n__touch") > 0)
        & (F.col(f"mean_{distance}") <= mean)
        & (F.col(f"max_{distance}") <= peak)
    )
    return P.keep_where(lab, rule, out, "_lab", (distance,), ("_touch",)).drop("_touch", "_lab")


#: Operator name -> (function of df, out and parameters, how often it reads df).
OPS: dict[str, tuple[Callable[..., DataFrame], int]] = {
    "sql": (_sql, 1),
    "normalise": (lambda df, out, **k: M.normalise(df, out=out, **k), 2),
    "stretch": (lambda df, out, **k: M.stretch_u8(df, out=out, **k), 2),
    "percentile_floor": (lambda df, out, **k: M.percentile_floor(df, out=out, **k), 2),
    "fill_median": (lambda df, out, **k: M.fill_median(df, out=out, **k), 2),
    "fill_nearest": (lambda df, out, **k: fill_nearest(df, out=out, **k), 3),
    "edge_distance": (lambda df, out, **k: edge_distance(df, out=out, **k), 1),
    "active_mask": (_active_mask, 4),
    "agreement": (_agree, 4),
    "noise_strength": (_noise_strength, 6),
    "fuse": (lambda df, out, **k: X.fuse(df, out=out, **k), 2),
    "flatten": (lambda df, out, **k: X.flatten(df, out=out, **k), 2),
    "contrast": (lambda df, out, **k: X.residual_contrast(df, out=out, **k), 2),
    "gaussian": (lambda df, out, **k: T.gaussian(df, out=out, **k), 1),
    "dark_scales": (lambda df, out, **k: T.dark_scales(df, out=out, **k), 2),
    "box": (lambda df, out, **k: T.box(df, out=out, **k), 1),
    "bank": (lambda df, out, **k: T.filter_bank_max(df, out=out, **k), 1),
    "dog": (lambda df, out, **k: T.dog_response(df, out=out, **k), 1),
    "median": (lambda df, out, **k: T.focal_median(df, out=out, **k), 1),
    "local_z": (lambda df, out, **k: T.local_z(df, out=out, **k), 1),
    "bilateral": (lambda df, out, **k: T.bilateral(df, out=out, **k), 1),
    "coherence": (lambda df, out, **k: T.coherence(df, out=out, **k), 1),
    "hessian": (lambda df, out, **k: T.hessian_response(df, out=out, **k), 4),
    "clahe": (lambda df, out, **k: Q.clahe(df, out=out, **k), 3),
    "tophat": (lambda df, out, **k: R.tophat(df, out=out, **k), 1),
    "blackhat": (lambda df, out, **k: R.blackhat(df, out=out, **k), 1),
    "erode": (lambda df, out, **k: R.erode(df, out=out, **k), 1),
    "dilate": (lambda df, out, **k: R.dilate(df, out=out, **k), 1),
    "opening": (lambda df, out, **k: R.opening(df, out=out, **k), 1),
    "closing": (lambda df, out, **k: R.closing(df, out=out, **k), 1),
    "threshold": (lambda df, out, **k: G.threshold(df, out=out, **k), 4),
    "elbow_mask": (_elbow_mask, 6),
    "fixed_levels": (lambda df, out, **k: G.fixed_levels(df, out=out, **k), 2),
    "adaptive_hysteresis": (_adaptive_mask, 6),
    "density_hysteresis": (lambda df, out, **k: G.density_hysteresis(df, out=out, **k), 2),
    "triangle_hysteresis": (lambda df, out, **k: G.triangle_hysteresis(df, out=out, **k), 2),
    "evidence_hysteresis": (lambda df, out, **k: G.evidence_hysteresis(df, out=out, **k), 2),
    "connected_levels": (lambda df, out, **k: G.connected_levels(df, out=out, **k), 2),
    "local_adaptive": (lambda df, out, **k: G.local_adaptive(df, out=out, **k), 4),
    "support_mask": (_support_mask, 5),
    "min_area": (lambda df, out, mask, n: _labelled(df, mask, lambda d, o: P.min_area(d, n, o, "_lab"), out), 2),
    "top_k": (lambda df, out, mask, k: _labelled(df, mask, lambda d, o: P.top_k(d, k, o, "_lab"), out), 2),
    "drop_border": (lambda df, out, mask, band: _labelled(df, mask, lambda d, o: P.drop_border(d, band, o, "_lab"), out), 2),
    "drop_edge_lines": (
        lambda df, out, mask, margin: _labelled(df, mask, lambda d, o: P.drop_edge_lines(d, margin, o, comp="_lab"), out),
        2,
    ),
    "elongated": (
        lambda df, out, mask, aspect, area: _labelled(df, mask, lambda d, o: P.keep_elongated(d, aspect, area, o, "_lab"), out),
        2,
    ),
    "shape_clean": (_shape_clean, 2),
    "thin": (lambda df, out, mask: thin(df, mask, out), 2),
    "reconnect": (lambda df, out, **k: reconnect(df, out=out, **k), 2),
    "suppress_blobs": (lambda df, out, **k: S.suppress_blobs(df, out=out, **k), 2),
    "clean_noise": (lambda df, out, **k: S.clean_noise(df, out=out, **k), 2),
    "near_tree": (lambda df, out, **k: S.near_tree(df, out=out, **k), 2),
    "recover": (lambda df, out, **k: S.recover_components(df, out=out, **k), 2),
    "gradient": (_gradient, 1),
    "quantile_mask": (_quantile_mask, 2),
    "hugging": (_hugging, 2),
    "fov": (lambda df, out, **k: S.fov_mask(df, out=out, **k), 2),
}


#: Operators that read small rasters several times all the same, for thresholds from histograms.
SEVERAL = {"threshold", "elbow_mask", "adaptive_hysteresis", "triangle_hysteresis", "evidence_hysteresis"}


def _uses(df: DataFrame, s: Step) -> int:
    """How often a step reads ``df``; statistics of small rasters are windows, which read it once."""
    linear = s.op not in SEVERAL or (s.op == "threshold" and s.params["method"] == "percentile")
    return 1 if linear and small_rasters(df) else OPS[s.op][1]


def _words(value: Any) -> set[str]:
    """Names a parameter may refer to."""
    if isinstance(value, str):
        return set(re.findall(r"[A-Za-z_]\w*", value))
    if isinstance(value, dict):
        return {w for k in value for w in _words(k)} | {w for v in value.values() for w in _words(v)}
    if isinstance(value, (list, tuple)):
        return {w for v in value for w in _words(v)}
    return set()


def run_recipe(df: DataFrame, steps: list[Step], keep: list[str]) -> DataFrame:
    """Run the steps in order and return the grid columns and ``keep``.

    Neighbouring steps on small rasters that have array twins (``stacks``) run in one call.
    """
    reads = [_words(s.params) for s in steps]
    needed_after = [set(keep).union(*reads[i + 1 :]) if reads[i + 1 :] else set(keep) for i in range(len(steps))]
    product = READS
    i = 0
    while i < len(steps):
        s, n = steps[i], stacks.leading(df, steps[i:])
        if n:
            df = stacks.run_steps(df, steps[i : i + n], set().union(*reads[i : i + n]), needed_after[i + n - 1])
            i += n
        else:
            fn, uses = OPS[s.op][0], _uses(df, s)
            if uses > 1 and product * uses > READS:
                df, product = cut(df), 1
            df = fn(df, s.out, **s.params)
            product *= uses
            i += 1
        df = df.select(*GRID, *[c for c in df.columns if c not in GRID and c in needed_after[i - 1]])
    return df.select(*GRID, *keep)


def _common(lists: list[list[Step]]) -> int:
    """How many leading steps all lists share."""
    n = 0
    while all(len(r) > n for r in lists) and all(r[n] == lists[0][n] for r in lists):
        n += 1
    return n


def run_variants(df: DataFrame, recipes: dict[str, list[Step]], keep: list[str]) -> DataFrame:
    """Run several recipes on one input; rows carry the recipe's name in ``variant``.

    Steps all recipes begin with run once, before they part. Steps all recipes
    end with also run once, over the union, with (image, variant) as the raster
    key: more rows per job instead of more jobs.
    """
    lists = list(recipes.values())
    head = _common(lists)
    tail = _common([r[head:][::-1] for r in lists])
    last = lists[0][len(lists[0]) - tail :]
    read_by_last = set(keep).union(*[_words(s.params) for s in last]) if tail else set(keep)
    if head:
        later = read_by_last.union(*[_words(s.params) for r in lists for s in r[head:]])
        given = [c for c in df.columns if c not in GRID]
        made = [s.out for s in lists[0][:head]]
        df = run_recipe(df, lists[0][:head], [c for c in dict.fromkeys([*given, *made]) if c in later])
    df = cut(df)
    given = [c for c in df.columns if c not in GRID]
    parts = []
    for name, steps in recipes.items():
        own = steps[head : len(steps) - tail]
        wanted = [c for c in dict.fromkeys([*given, *[s.out for s in own]]) if c in read_by_last]
        # every branch must offer the same columns to the shared tail
        parts.append((name, run_recipe(df, own, wanted), wanted))
    same = [c for c in parts[0][2] if all(c in w for _, _, w in parts)]
    union = None
    for name, part, _ in parts:
        key = F.struct(F.col("image_id").alias("id"), F.lit(name).alias("variant")).alias("image_id")
        part = part.select(key, *[c for c in GRID if c != "image_id"], *same)
        union = part if union is None else union.unionByName(part)
    if tail:
        union = run_recipe(cut(union), last, keep)
    return union.select(
        F.col("image_id.id").alias("image_id"), *[c for c in GRID if c != "image_id"], *keep, F.col("image_id.variant").alias("variant")
    )
