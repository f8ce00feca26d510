"""Erosion, dilation and their composites on value or mask columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.tiles import run

Element = list[tuple[int, int]]


def extreme_chains(df: DataFrame, specs: dict[str, tuple[str, list[tuple[Element, str]]]]) -> DataFrame:
    """Minima and maxima one after another, in one pass: out -> (column, [(element, 'min' | 'max'), ...]).

    Cells outside the raster take no part. Work on a cell is constant for lines
    and boxes of any length, and goes with the number of rows of other elements.
    """
    reach = max(sum(max(max(abs(a), abs(b)) for a, b in el) for el, _ in steps) for _, steps in specs.values())

    def chain(b):
        made, done = {}, {}
        for out, (col, steps) in specs.items():
            layer, path = b.layers[col], (col,)
            for el, kind in steps:
                path = (*path, kind, tuple(el))  # chains with the same beginning share it
                layer = done[path] if path in done else done.setdefault(path, b.extreme(layer, el, kind))
            made[out] = layer
        return made

    return run(df, sorted({c for c, _ in specs.values()}), reach, chain, {o: c for o, (c, _) in specs.items()})


def extremes(df: DataFrame, specs: dict[str, tuple[str, Element, str]]) -> DataFrame:
    """Several window minima or maxima in one pass: out -> (column, element, 'min' | 'max')."""
    return extreme_chains(df, {o: (c, [(el, kind)]) for o, (c, el, kind) in specs.items()})


def erode(df: DataFrame, value: str, element: Element, out: str) -> DataFrame:
    return extremes(df, {out: (value, element, "min")})


def dilate(df: DataFrame, value: str, element: Element, out: str) -> DataFrame:
    return extremes(df, {out: (value, element, "max")})


def opening(df: DataFrame, value: str, element: Element, out: str) -> DataFrame:
    return extreme_chains(df, {out: (value, [(element, "min"), (element, "max")])})


def closing(df: DataFrame, value: str, element: Element, out: str, times: int = 1) -> DataFrame:
    """Close; ``times`` repeats the dilations before the erosions."""
    return extreme_chains(df, {out: (value, [(element, "max")] * times + [(element, "min")] * times)})


def _hats(df, value, elements, first, second, sign):
    """One opening or closing per element, all elements in one pass."""
    temps = [f"_q{i}" for i in range(len(elements))]
    df = extreme_chains(df, {q: (value, [(el, first), (el, second)]) for q, el in zip(temps, elements)})
    return df, [F.greatest(sign * (F.col(value) - F.col(q)), F.lit(0.0)) for q in temps], temps


def _combine(hats, how):
    if len(hats) == 1:
        return hats[0]
    return F.greatest(*hats) if how == "max" else sum(hats) / float(len(hats))


def tophat(df: DataFrame, value: str, elements: list[Element], out: str, combine: str = "max") -> DataFrame:
    """White top-hat over a set of elements: what each opening removes, combined."""
    df, hats, temps = _hats(df, value, elements, "min", "max", 1.0)
    return df.withColumn(out, _combine(hats, combine)).drop(*temps)


def blackhat(df: DataFrame, value: str, elements: list[Element], out: str, combine: str = "max") -> DataFrame:
    """Black-hat: what each closing adds, combined."""
    df, hats, temps = _hats(df, value, elements, "max", "min", -1.0)
    return df.withColumn(out, _combine(hats, combine)).drop(*temps)
