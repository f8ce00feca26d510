"""Steps on small rasters held whole: array twins of operators.

A stencil ends in Python and the statistics after it in a window, so a recipe shuffles
all its cells again after every stencil. Here a run of steps is one call on stacks of
rasters: one shuffle, whatever the number of steps. Each twin gives what its operator
gives on the cell table, nulls and missing cells included; steps without a twin stay there.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import kernels as K
from cellgrove.operators.cells import GRID
from cellgrove.operators.quantiles import small_rasters
from cellgrove.operators.tiles import Block, Layer, one_tile, run

#: Column of cells that have a row.
HERE = "_here"


def true(layer: Layer) -> np.ndarray:
    return (layer[0] > 0.5) & layer[1]


def clip(values: np.ndarray) -> np.ndarray:
    """To [0, 1]; not-a-number is larger than any number."""
    return np.fmin(np.maximum(values, 0.0), 1.0)


def percentiles(values: np.ndarray, on: np.ndarray, shares: list[float]) -> list[np.ndarray]:
    """Linear-interpolation percentiles of each raster's counted values, not-a-number where none counts."""
    cells = values.shape[0] * values.shape[1]
    ranked = np.where(on, values, np.nan).reshape(cells, -1)
    ranked.sort(axis=0)
    count = on.reshape(cells, -1).sum(0)
    out = []
    for share in shares:
        place = np.maximum(count - 1, 0) * share
        low, high = np.floor(place), np.ceil(place)
        a, b = (np.take_along_axis(ranked, at.astype(np.int64)[None], 0)[0] for at in (low, high))
        out.append(np.where(a == b, a, np.where(low == high, a, (high - place) * a + (place - low) * b)).reshape(values.shape[2:]))
    return out


def _extreme(values: np.ndarray, on: np.ndarray, kind: str) -> np.ndarray:
    """Least or largest counted value of each raster, not-a-number where none counts."""
    best, far = (np.minimum, np.inf) if kind == "min" else (np.maximum, -np.inf)
    return np.where(on.any((0, 1)), best.reduce(np.where(on, values, far), (0, 1)), np.nan)


def normalise(b: Block, value: str, mask: str | None, variant: str = "fallback", lo: float = 0.01, hi: float = 0.99) -> Layer:
    values, known = b.layers[value]
    on = known & np.isfinite(values) & (true(b.layers[mask]) if mask else True)
    low, high = percentiles(values, on, [lo, hi])
    if variant == "floor":
        counts, span = known & on.any((0, 1)), np.maximum(high - low, 1e-8)
    else:
        wide = high > low
        low, high = np.where(wide, low, _extreme(values, on, "min")), np.where(wide, high, _extreme(values, on, "max"))
        counts, span = known & (high > low), high - low
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return np.where(counts, clip((values - low) / span), 0.0), b.layers[HERE][1]


def _hats(b: Block, value: str, elements: list, first: str, second: str, sign: float, combine: str) -> Layer:
    values, known = b.layers[value]
    hats = []
    for el in elements:
        found, some = b.extreme(b.extreme((values, known), el, first), el, second)
        hats.append(np.maximum(np.where(known & some, sign * (values - found), 0.0), 0.0))
    if len(hats) == 1:
        best = hats[0]
    else:
        best = np.maximum.reduce(hats) if combine == "max" else sum(hats) / float(len(hats))
    return best, b.layers[HERE][1]


def _smooth(b: Block, value: str, line: dict[int, float], border: str) -> Layer:
    values, some = b.separable(b.layers[value], line, border)
    return values, some & b.layers[HERE][1]


def _bank(b: Block, value: str, bank: list[K.Kernel], border: str, least: float = 0.0) -> Layer:
    best = np.full(b.layers[value][0].shape, least)
    for values, some in b.correlate(b.layers[value], bank, border):
        best = np.maximum(best, np.where(some, values, least))
    return best, b.layers[HERE][1]


def _hessian(b: Block, value: str, sigmas: tuple, method: str, mask: str, border: str = "reflect", radius: int | None = None, beta: float = 0.5) -> Layer:
    m, orders = true(b.layers[mask]), ((2, 0), (1, 1), (0, 2))
    found = b.correlate(b.layers[value], [K.gaussian_derivative(s, *o, radius) for s in sigmas for o in orders], border)
    best = np.zeros(m.shape)
    with np.errstate(all="ignore"):
        for i, sigma in enumerate(sigmas):
            (yy, known), (xy, _), (xx, _) = found[3 * i : 3 * i + 3]
            known = known & b.layers[HERE][1]
            half, root = (yy + xx) / 2.0, np.sqrt(((yy - xx) / 2.0) ** 2 + xy * xy)
            hi, lo = half + root, half - root
            s, scale = -lo, float(sigma**2)
            if method == "jerman":
                # not-a-number is above zero, here and in the operator
                on = known & m & ~(s <= 0)
                (top,) = percentiles(s, on, [0.99])
                r = np.where(~(s <= 0) & on.any((0, 1)) & ~(top <= 0), clip(s / top) * np.exp(-(hi * hi) / (2.0 * (s * s + 1e-6))), 0.0)
            else:
                top = _extreme(np.sqrt(hi * hi + lo * lo) * scale, known, "max") / 2.0
                big = np.abs(lo) >= np.abs(hi)
                l1, l2 = np.where(big, hi, lo) * scale, np.where(big, lo, hi) * scale
                texture = 1.0 - np.exp(-(l1 * l1 + l2 * l2) / (2.0 * top * top))
                r = np.where((l2 < 0) & ~(top <= 0), np.exp(-((l1 / l2) ** 2) / (2.0 * beta**2)) * texture, 0.0)
            best = np.maximum(best, np.where(known, r, 0.0))
    made = Block({"_resp": (np.where(m, best, 0.0), b.layers[HERE][1]), mask: b.layers[mask], HERE: b.layers[HERE]}, b.origin, b.size)
    return normalise(made, "_resp", mask)


def _fuse(b: Block, weights: dict[str, float], mask: str, scale: bool = True) -> Layer:
    mixed = sum(float(w) * b.layers[c][0] for c, w in weights.items())
    known = np.logical_and.reduce([b.layers[c][1] for c in weights]) & b.layers[HERE][1]
    if not scale:
        return mixed, known
    return normalise(Block({**b.layers, "_mix": (mixed, known)}, b.origin, b.size), "_mix", mask)


def parsed(text: str) -> ast.expr | None:
    """The expression in names, numbers, + - *, ``if`` on a named mask, ``least`` and ``greatest``; None for any other."""
    plain = re.sub(r"\b(\d+(?:\.\d+)?)D\b", r"\1", re.sub(r"\bif\s*\(", "if_(", text))
    try:
        tree = ast.parse(plain, mode="eval").body
    except SyntaxError:
        return None

    def fits(e: ast.expr) -> bool:
        if isinstance(e, ast.BinOp):
            return isinstance(e.op, (ast.Add, ast.Sub, ast.Mult)) and fits(e.left) and fits(e.right)
        if isinstance(e, ast.Call):
            if not isinstance(e.func, ast.Name) or e.keywords:
                return False
            if e.func.id == "if_":
                return len(e.args) == 3 and isinstance(e.args[0], ast.Name) and all(fits(a) for a in e.args[1:])
            return e.func.id in ("least", "greatest") and len(e.args) > 1 and all(fits(a) for a in e.args)
        return isinstance(e, ast.Name) or (isinstance(e, ast.Constant) and type(e.value) in (int, float))

    return tree if fits(tree) else None


def names(e: ast.expr) -> tuple[set[str], set[str]]:
    """Columns that a parsed expression takes as values, and as masks."""
    if isinstance(e, ast.Name):
        return {e.id}, set()
    parts = [e.left, e.right] if isinstance(e, ast.BinOp) else e.args if isinstance(e, ast.Call) else []
    masks = {parts[0].id} if isinstance(e, ast.Call) and e.func.id == "if_" else set()
    found = [names(p) for p in (parts[1:] if masks else parts)]
    return set().union(*[v for v, _ in found]), masks.union(*[m for _, m in found])


def _evaluated(b: Block, e: ast.expr) -> Layer:
    here = b.layers[HERE][1]
    if isinstance(e, ast.Name):
        return b.layers[e.id]
    if isinstance(e, ast.Constant):
        return np.full(here.shape, float(e.value)), here
    if isinstance(e, ast.BinOp):
        (x, p), (y, q) = _evaluated(b, e.left), _evaluated(b, e.right)
        return (x + y if isinstance(e.op, ast.Add) else x - y if isinstance(e.op, ast.Sub) else x * y), p & q
    if e.func.id == "if_":
        on, (x, p), (y, q) = true(b.layers[e.args[0].id]), *[_evaluated(b, a) for a in e.args[1:]]
        return np.where(on, x, y), np.where(on, p, q)
    best = np.fmin if e.func.id == "least" else np.maximum
    values, known = _evaluated(b, e.args[0])
    for a in e.args[1:]:
        more, some = _evaluated(b, a)
        values, known = np.where(known & some, best(values, more), np.where(known, values, more)), known | some
    return values, known


def _sql(b: Block, text: str) -> Layer:
    values, known = _evaluated(b, parsed(text))
    return values, known & b.layers[HERE][1]


#: Operator name -> (twin, whether it is a stencil, parameters that it knows).
TWINS: dict[str, tuple[Callable[..., Layer], bool, set[str]]] = {
    "sql": (_sql, False, {"text"}),
    "normalise": (normalise, False, {"value", "mask", "variant", "lo", "hi"}),
    "fuse": (_fuse, False, {"weights", "mask", "scale"}),
    "gaussian": (
        lambda b, value, sigma, border, radius=None: _smooth(b, value, K.gaussian_line(sigma, radius=radius), border),
        True,
        {"value", "sigma", "border", "radius"},
    ),
    "box": (lambda b, value, k, border: _smooth(b, value, K.box_line(k), border), True, {"value", "k", "border"}),
    "tophat": (lambda b, value, elements, combine="max": _hats(b, value, elements, "min", "max", 1.0, combine), True, {"value", "elements", "combine"}),
    "blackhat": (lambda b, value, elements, combine="max": _hats(b, value, elements, "max", "min", -1.0, combine), True, {"value", "elements", "combine"}),
    "bank": (_bank, True, {"value", "bank", "border", "least"}),
    "hessian": (_hessian, True, {"value", "sigmas", "method", "mask", "border", "radius", "beta"}),
}


def has_twin(op: str, params: dict[str, Any], kinds: dict[str, str]) -> bool:
    """Whether the step has a twin for these parameters and for columns of these types."""
    if op not in TWINS or not set(params) <= TWINS[op][2]:
        return False
    if op == "sql":
        tree = parsed(params["text"])
        values, masks = names(tree) if tree is not None else (set(), set())
        if not values:
            return False
    else:
        values = set(params["weights"]) if op == "fuse" else {params["value"]}
        masks = {params["mask"]} if params.get("mask") else set()
    if params.get("variant", "fallback") not in ("fallback", "floor") or params.get("method", "frangi") not in ("frangi", "jerman"):
        return False
    return all(kinds.get(c) == "double" for c in values) and all(kinds.get(c) == "boolean" for c in masks)


def leading(df: DataFrame, steps: list) -> int:
    """How many of the first steps one call takes: 0 unless there are several, one of them a stencil."""
    if not (small_rasters(df) and one_tile(df)):
        return 0
    kinds, n = {f.name: f.dataType.simpleString() for f in df.schema.fields}, 0
    while n < len(steps) and has_twin(steps[n].op, steps[n].params, kinds):
        kinds[steps[n].out] = "double"
        n += 1
    wide = [s for s in steps[:n] if s.op != "sql"]
    return n if len(wide) > 1 and any(TWINS[s.op][1] for s in wide) else 0


def run_steps(df: DataFrame, steps: list, reads: set[str], keep: set[str]) -> DataFrame:
    """The steps in one call. ``reads`` are words that may name columns they read, ``keep`` the columns wanted after."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    inputs = [c for c in df.columns if c not in GRID and c in reads and kinds[c] in ("double", "boolean")]
    outputs = {s.out: "" for s in steps if s.out in keep}
    given = df.select(*GRID, *[c for c in df.columns if c not in GRID and (c in inputs or c in keep)], F.lit(True).alias(HERE))

    def chain(block: Block) -> dict[str, Layer]:
        b = Block(dict(block.layers), block.origin, block.size)
        for s in steps:
            b.layers[s.out] = TWINS[s.op][0](b, **s.params)
        return {o: b.layers[o] for o in outputs}

    return run(given, [*inputs, HERE], 0, chain, outputs).drop(HERE)
