"""Row-local expressions over a class axis held in an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside lambdas, where Spark would repeat it."""
    return F.transform(F.array(value), body)[0]


def argmax(arr: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def _raised(arr: Column) -> Column:
    return let(F.array_max(arr), lambda top: F.transform(arr, lambda v: F.exp(v - top)))


def softmax(arr: Column) -> Column:
    return let(_raised(arr), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def log_softmax(arr: Column) -> Column:
    norm = F.array_max(arr) + F.log(total(_raised(arr)))
    return let(norm, lambda s: F.transform(arr, lambda v: v - s))


def shift_class(arr: Column, cls: int, delta) -> Column:
    """Add a bias to one class's score."""
    return F.transform(arr, lambda v, i: F.when(i == cls, v + delta).otherwise(v))


def shift_probability(arr: Column, cls: int, delta: float) -> Column:
    """Shift one class's probability, floor at zero, renormalise."""
    moved = F.transform(
        arr, lambda v, i: F.when(i == cls, F.greatest(v + delta, F.lit(0.0))).otherwise(v)
    )
    return let(
        moved,
        lambda m: let(F.greatest(total(m), F.lit(1e-8)), lambda s: F.transform(m, lambda v: v / s)),
    )


def soft_targets(
    label: Column, n_classes: int, smoothing: float, eps: float = 0.0, ordinal: tuple[int, ...] = ()
) -> Column:
    """Label-smoothed target row; ordered classes also give ``eps`` to their neighbours.

    Neighbours are the adjacent ids inside ``ordinal``; a class off that axis
    neither gives nor receives neighbour mass.
    """
    floor = smoothing / (n_classes - 1)
    on_axis = label.isin(*ordinal) if ordinal else F.lit(False)
    count = sum(((label + s).isin(*ordinal)).cast("int") for s in (-1, 1)) if ordinal else F.lit(0)
    gives = on_axis & (count > 0)
    peak = F.lit(1.0 - smoothing) - F.when(on_axis, F.lit(eps)).otherwise(0.0)

    def mass(i):
        near = gives & (F.abs(i - label) == 1) & (i.isin(*ordinal) if ordinal else F.lit(False))
        return (
            F.when(i == label, peak).when(near, F.lit(floor) + F.lit(eps) / count).otherwise(F.lit(floor))
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), mass)


def soft_cross_entropy(logits: Column, targets: Column, weights: list[float] | Column) -> Column:
    """Weighted cross-entropy of one row against a soft target."""
    if isinstance(weights, list):
        weights = F.array(*[F.lit(float(w)) for w in weights])
    weighted = F.zip_with(weights, targets, lambda w, q: w * q)
    return -total(F.zip_with(weighted, log_softmax(logits), lambda wq, lp: wq * lp))


def expected_rank(logits: Column, ordinal: tuple[int, ...]) -> Column:
    """Mean class id under the softmax restricted to the ordered classes."""
    on_axis = F.transform(softmax(logits), lambda p, i: F.when(i.isin(*ordinal), p).otherwise(0.0))
    return let(
        on_axis,
        lambda q: total(F.transform(q, lambda p, i: p * i)) / F.greatest(total(q), F.lit(1e-8)),
    )
