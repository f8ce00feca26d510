"""Stencil chains on tiles with copied margins.

Rasters are cut into square tiles; a tile travels with a margin as wide as a whole
chain of stencils reaches, is laid out as arrays, and runs the chain in one task. A chain
is thus one shuffle of little more than one row a cell, whatever its length and the
sizes of its windows, and a huge raster spreads over as many tasks as it has tiles.
Tiles of one shape that arrive together run stacked along a third axis, so that many
small rasters cost a few steps a batch and not a few a raster.

Windows follow the rules of the cell table: a cell that is missing, null or, with a
constant border, outside the raster takes no part, and a window without any cell that
does gives null. Not-a-number counts as larger than any number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from cellgrove.operators.cells import GRID
from cellgrove.operators.quantiles import MAX_SIDE

#: Side of a tile; wider where a chain reaches far, so that margins stay the smaller part.
TILE = 256
BORDERS = ("reflect", "reflect101", "replicate", "constant")
#: Values that one step of a correlation holds at once.
WORK_CELLS = 1 << 22
#: Widest median window that stacks of tiles sort.
SORTED_SIDE = 9

#: A column of a tile: values, and where they are known.
Layer = tuple[np.ndarray, np.ndarray]


def border_index(places: np.ndarray, size: int, border: str) -> np.ndarray:
    """Place inside the raster that each place shows; -1 for none."""
    if border == "constant":
        return np.where((places >= 0) & (places < size), places, -1)
    if border == "replicate":
        return np.clip(places, 0, size - 1)
    if border == "reflect":
        turned = places % (2 * size)
        return np.minimum(turned, 2 * size - 1 - turned)
    if border == "reflect101":
        turned = places % max(2 * size - 2, 1)
        return np.minimum(turned, max(2 * size - 2, 1) - turned) if size > 1 else np.zeros_like(places)
    raise ValueError(border)


class Block:
    """One tile with its margin: layers by column name, and where it lies in its raster.

    Layers may have a third axis: tiles that lie alike in rasters of one size.
    """

    def __init__(self, layers: dict[str, Layer], origin: tuple[int, int], size: tuple[int, int]):
        self.layers, self.origin, self.size = layers, origin, size

    def padded(self, layer: Layer, ry: int, rx: int, border: str) -> Layer:
        """The layer with ``ry`` rows and ``rx`` columns more on each side.

        What lies beyond the margin is unknown and only ever reaches cells of the margin.
        """
        values, known = layer
        for axis, r in ((0, ry), (1, rx)):
            if r == 0:
                continue
            n = values.shape[axis]
            at = border_index(np.arange(-r, n + r) + self.origin[axis], self.size[axis], border) - self.origin[axis]
            inside = (at >= 0) & (at < n)
            at = np.where(inside, at, 0)
            values, known = values.take(at, axis), known.take(at, axis)
            known = known & inside.reshape([-1 if i == axis else 1 for i in range(known.ndim)])
        return np.where(known, values, 0), known

    def correlate(self, layer: Layer, kernels: list[dict[tuple[int, int], float]], border: str) -> list[Layer]:
        """Sums of weight times value at ``place + (dy, dx)``; kernels share one gathering of the cells."""
        taps = sorted({t for k in kernels for t in k})
        weights = np.array([[k.get(t, 0.0) for t in taps] for k in kernels])
        ry, rx = (max(abs(t[i]) for t in taps) for i in (0, 1))
        values, known = self.padded(layer, ry, rx, border)
        shape = layer[0].shape
        n, m, *more = shape
        whole = bool(known.all())
        out, any_ = np.empty((len(kernels), *shape)), np.zeros(shape, bool)
        rows = max(1, WORK_CELLS // (len(taps) * max(1, layer[0][0].size)))
        for a in range(0, n, rows):
            b = min(n, a + rows)
            cells = np.stack([values[ry + dy + a : ry + dy + b, rx + dx : rx + dx + m].reshape(-1) for dy, dx in taps])
            out[:, a:b] = (weights @ cells).reshape(len(kernels), b - a, m, *more)
            if not whole:
                for dy, dx in taps:
                    any_[a:b] |= known[ry + dy + a : ry + dy + b, rx + dx : rx + dx + m]
        return [(o, np.ones(shape, bool) if whole else any_) for o in out]

    def separable(self, layer: Layer, line: dict[int, float], border: str) -> Layer:
        """Row pass, then column pass, of a one-dimensional kernel."""
        row = self.correlate(layer, [{(0, d): w for d, w in line.items()}], border)[0]
        return self.correlate(row, [{(d, 0): w for d, w in line.items()}], border)[0]

    def extreme(self, layer: Layer, element: Iterable[tuple[int, int]], kind: str) -> Layer:
        """Least or largest value under an element, as running extrema over its runs; no cell outside takes part."""
        element = set(element)
        ry, rx = (max(abs(t[i]) for t in element) for i in (0, 1))
        values, known = self.padded(layer, ry, rx, "constant")
        shape = layer[0].shape
        far = np.inf if kind == "min" else -np.inf
        odd = known & np.isnan(values)
        parts = [np.where(known & ~odd if kind == "min" else known, values, far)]
        some = known if not known.all() else None
        # a window of not-a-numbers alone has no number as its least value
        parts += [x.astype(np.float64) for x in ((known & ~odd) if kind == "min" and odd.any() else None, some) if x is not None]
        kinds = [kind, *["max"] * (len(parts) - 1)]
        found = [_over_runs(p, element, (ry, rx), shape[:2], k) for p, k in zip(parts, kinds)]
        out = found[0]
        if kind == "min" and odd.any():
            out = np.where(found[1] > 0, out, np.nan)
        return out, (found[-1] > 0) if some is not None else np.ones(shape, bool)

    def median(self, layer: Layer, k: int, border: str) -> Layer:
        """Median of the k x k window; of an even number of values the mean of the middle two."""
        if layer[0].ndim == 3:
            each = [self.median((layer[0][..., i], layer[1][..., i]), k, border) for i in range(layer[0].shape[2])] if k > SORTED_SIDE else []
            return tuple(np.stack(x, -1) for x in zip(*each)) if each else self._sorted_median(layer, k, border)
        low, high = k // 2, k - 1 - k // 2
        values, known = self.padded(layer, low, low, border)
        n, m = layer[0].shape
        values, known = values[: n + low + high, : m + low + high], known[: n + low + high, : m + low + high]
        if not known.any():
            return np.zeros((n, m)), np.zeros((n, m), bool)
        steps, rank = np.unique(values[known], return_inverse=True)  # not-a-number sorts last
        ranks = np.full(values.shape, -1, np.int64)
        ranks[known] = rank
        return sliding_median(ranks, steps, k, (n, m))

    def _sorted_median(self, layer: Layer, k: int, border: str) -> Layer:
        """``median`` by sorting every window, for stacks and narrow windows."""
        low = k // 2
        values, known = self.padded(layer, low, low, border)
        values = np.where(known, values, np.nan)  # sorts last, as a known not-a-number does
        n, m, tiles = layer[0].shape
        out, some = np.zeros((n, m, tiles)), np.zeros((n, m, tiles), bool)
        rows = max(1, WORK_CELLS // (k * k * max(1, m * tiles)))
        for a in range(0, n, rows):
            b = min(n, a + rows)
            places = [np.s_[a + dy : b + dy, dx : dx + m] for dy in range(k) for dx in range(k)]
            window = np.stack([values[p] for p in places])
            window.sort(axis=0)
            count = sum(known[p].astype(np.int64) for p in places)
            lower, upper = (np.take_along_axis(window, np.maximum(at, 0)[None], 0)[0] for at in ((count - 1) // 2, np.minimum(count // 2, k * k - 1)))
            some[a:b] = count > 0
            with np.errstate(invalid="ignore"):
                out[a:b] = np.where(some[a:b], np.where(lower == upper, lower, (lower + upper) / 2.0), 0.0)
        return out, some


def running_extreme(values: np.ndarray, width: int, axis: int, kind: str) -> np.ndarray:
    """Extreme of each stretch of ``width`` values, from running extremes inside blocks of that width.

    Two running extremes and one comparison a value, however wide the stretch.
    """
    if width == 1:
        return values
    best = np.minimum if kind == "min" else np.maximum
    v = np.moveaxis(values, axis, -1)
    n = v.shape[-1]
    fill = np.inf if kind == "min" else -np.inf
    blocks = -(-n // width)
    v = np.concatenate([v, np.full((*v.shape[:-1], blocks * width - n), fill)], axis=-1).reshape(*v.shape[:-1], blocks, width)
    ahead = best.accumulate(v, axis=-1).reshape(*v.shape[:-2], -1)
    behind = best.accumulate(v[..., ::-1], axis=-1)[..., ::-1].reshape(*v.shape[:-2], -1)
    return np.moveaxis(best(behind[..., : n - width + 1], ahead[..., width - 1 : n]), -1, axis)


def runs_of(element: Iterable[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Runs of an element: (first dx, width) -> the rows dy that have it."""
    rows: dict[int, list[int]] = {}
    for dy, dx in sorted(set(element)):
        rows.setdefault(dy, []).append(dx)
    out: dict[tuple[int, int], list[int]] = {}
    for dy, xs in rows.items():
        first = xs[0]
        for before, x in zip(xs, [*xs[1:], None]):
            if x != before + 1:
                out.setdefault((first, before - first + 1), []).append(dy)
                first = x
    return out


def _over_runs(values: np.ndarray, element: set, reach: tuple[int, int], shape: tuple[int, int], kind: str) -> np.ndarray:
    """Extreme over an element: running extremes of its distinct runs, and again down rows that share one."""
    best = np.minimum if kind == "min" else np.maximum
    (ry, rx), (n, m), out = reach, shape, None
    wide: dict[int, np.ndarray] = {}
    for (first, width), dys in runs_of(element).items():
        if width not in wide:
            wide[width] = running_extreme(values, width, 1, kind)
        at, dys = 0, sorted(dys)
        while at < len(dys):
            end = at
            while end + 1 < len(dys) and dys[end + 1] == dys[end] + 1:
                end += 1
            tall = end - at + 1
            part = wide[width][ry + dys[at] : ry + dys[at] + n + tall - 1, rx + first : rx + first + m]
            part = running_extreme(part, tall, 0, kind)
            out = part if out is None else best(out, part)
            at = end + 1
    return out


def sliding_median(ranks: np.ndarray, steps: np.ndarray, k: int, shape: tuple[int, int]) -> Layer:
    """Medians of k x k windows of ranks into ``steps`` (-1: no value), by a histogram that moves along each row.

    The histogram has two levels, so a median is found by two short searches; a move
    takes in one column of the window and lets another one go. All rows move together.
    """
    n, m = shape
    fine_n = max(1, int(np.ceil(np.sqrt(len(steps)))))
    coarse, fine = np.zeros((n, fine_n + 1), np.int32), np.zeros((n, fine_n * (fine_n + 1)), np.int32)
    count = np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), k)
    out, known = np.zeros((n, m)), np.zeros((n, m), bool)

    def move(column: int, by: int) -> None:
        entering = np.lib.stride_tricks.sliding_window_view(ranks[:, column], k).reshape(-1)
        on = entering >= 0
        r, e = row[on], entering[on]
        np.add.at(fine, (r, e), by)
        np.add.at(coarse, (r, e // fine_n), by)
        count[:] += by * np.bincount(r, minlength=n)

    def find(place: np.ndarray) -> np.ndarray:
        """Rank of the value at a 0-based place of each row's window."""
        sums = coarse.cumsum(1)
        c = np.minimum((sums <= place[:, None]).sum(1), fine_n)  # the last bin stays empty; an empty window ends there
        left = place - np.where(c > 0, np.take_along_axis(sums, np.maximum(c - 1, 0)[:, None], 1)[:, 0], 0)
        inner = np.take_along_axis(fine, c[:, None] * fine_n + np.arange(fine_n), 1).cumsum(1)
        return c * fine_n + (inner <= left[:, None]).sum(1)

    for column in range(k - 1):
        move(column, 1)
    for x in range(m):
        move(x + k - 1, 1)
        some = count > 0
        low = find(np.where(some, (count - 1) // 2, 0))
        high = find(np.where(some, count // 2, 0)) if (count % 2 == 0).any() else low
        a, b = steps[np.minimum(low, len(steps) - 1)], steps[np.minimum(high, len(steps) - 1)]
        out[:, x], known[:, x] = np.where(low == high, a, (a + b) / 2.0), some
        move(x, -1)
    return out, known


def _tiles(axis: str, size: str, reach: int, tile: int) -> Column:
    """Numbers of the tiles along an axis whose margin covers the cell."""
    first = F.greatest(F.floor((F.col(axis) - reach) / tile), F.lit(0))
    last = F.least(F.floor((F.col(axis) + reach) / tile), F.floor((F.col(size) - 1) / tile))
    return F.explode(F.sequence(first, last))


def _codes(column: pa.Array) -> list[np.ndarray]:
    """Whole numbers that are equal where the values are; a struct has those of its fields."""
    if pa.types.is_struct(column.type):
        return [c for part in column.flatten() for c in _codes(part)]
    return [column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)]


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row has other keys than the row before."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        for code in _codes(table[key].combine_chunks()):
            new[1:] |= code[1:] != code[:-1]
    return new


def over_groups(df: DataFrame, keys: list[str], make: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """Rows that ``make`` gives for whole groups of equal keys, many small groups in one call.

    It gets a table of whole groups, one after another, and the number of each row's group in
    it. A call holds one Arrow batch and one group more. Groups are told apart by sorting, and a
    call for each would cost milliseconds.
    """

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            new = _begins(table, keys)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from make(table.slice(0, last), np.cumsum(new[:last]) - 1).to_batches()
            held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from make(table, np.zeros(table.num_rows, np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(on_batches, schema)


def alike(number: np.ndarray, traits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, ...]]]:
    """Groups with equal traits: their rows, each row's place among the groups, and the traits."""
    rows = np.stack(traits, 1)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    kinds, kind = np.unique(rows[first], axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    for i, k in enumerate(kinds):
        place = np.cumsum(kind == i) - 1
        at = np.flatnonzero(kind[number] == i)
        yield at, place[number[at]], tuple(int(v) for v in k)


def one_tile(df: DataFrame, tile: int = TILE) -> bool:
    """Whether the table's bound says that every raster lies within one tile."""
    bound = df.schema["h"].metadata.get(MAX_SIDE)
    return bound is not None and bound <= tile


def run(df: DataFrame, inputs: list[str], reach: int, chain: Callable[[Block], dict[str, Layer]], outputs: dict[str, str], tile: int | None = None) -> DataFrame:
    """Adds the layers that ``chain`` makes of each tile's ``inputs`` as columns.

    ``outputs`` names them with the column whose type they take, or '' for
    double. ``reach`` is the sum of the reaches of the chain's stencils; an
    output of a name that exists replaces the column. Other columns are carried along.
    """
    tile = tile or max(TILE, 4 * reach)
    kept = [c for c in df.columns if c not in GRID and c not in outputs]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    types = {o: kinds[c] if c else DoubleType() for o, c in outputs.items()}
    single = one_tile(df, tile)
    if single:  # the image alone is the key, as it is for the statistics of small rasters
        spread = df.withColumns({"_ty": F.lit(0), "_tx": F.lit(0)})
    else:
        spread = df.withColumn("_ty", _tiles("y", "h", reach, tile)).withColumn("_tx", _tiles("x", "w", reach, tile))
    schema = StructType([df.schema[c] for c in [*GRID, *kept]] + [StructField(o, t) for o, t in types.items()])
    true = {o for o, t in types.items() if isinstance(t, BooleanType)}

    def on_tiles(table: pa.Table, number: np.ndarray) -> pa.Table:
        place = {c: table[c].to_numpy().astype(np.int64) for c in ("h", "w", "y", "x", "_ty", "_tx")}
        given = {}
        for c in inputs:
            column = table[c].combine_chunks()
            given[c] = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        found = {o: (np.zeros(table.num_rows), np.zeros(table.num_rows, bool)) for o in outputs}
        own = (place["y"] // tile == place["_ty"]) & (place["x"] // tile == place["_tx"])
        for rows, nth, (h, w, ty, tx) in alike(number, [place[c] for c in ("h", "w", "_ty", "_tx")]):
            y0, x0 = max(0, ty * tile - reach), max(0, tx * tile - reach)
            shape = min(h, (ty + 1) * tile + reach) - y0, min(w, (tx + 1) * tile + reach) - x0, int(nth.max()) + 1
            at = place["y"][rows] - y0, place["x"][rows] - x0, nth
            if shape[2] == 1:
                shape, at = shape[:2], at[:2]
            layers = {}
            for c, (column, valid) in given.items():
                values, known = np.zeros(shape), np.zeros(shape, bool)
                values[at], known[at] = column[rows], valid[rows]
                layers[c] = values, known
            made = chain(Block(layers, (y0, x0), (h, w)))
            for o, (values, known) in found.items():
                values[rows], known[rows] = made[o][0][at], made[o][1][at]
        out = table.filter(pa.array(own)).select([*GRID, *kept])
        for o, (values, known) in found.items():
            values = values[own] > 0.5 if o in true else values[own]
            out = out.append_column(o, pa.array(values, mask=~known[own]).cast(kind[o]))
        return out

    from pyspark.sql.pandas.types import to_arrow_type

    kind = {o: to_arrow_type(t) for o, t in types.items()}
    return over_groups(spread, ["image_id"] if single else ["image_id", "_ty", "_tx"], on_tiles, schema)
