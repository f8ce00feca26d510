"""Clusters against a plain exact version, and bounds against exact distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrove.llm import ptolemy as P

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows, k=8, rounds=10, dim=64):
    """Lloyd's rounds from the definition, in Python's whole numbers."""
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(good, key=lambda r: (r[0] is None, SHA(f"3:{r[0]}"), r[1]))[:k]
    cs = [list(x) for _, x in seeds]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min((d2(x, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in good]
        for n in range(len(cs)):
            mine = [x for (_, x), o in zip(good, own) if o == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [nearest(x) for _, x in good]
    per = {n: sum(d for d, o in last if o == n) for n in range(len(cs))}
    return sorted(((i, n, d, per[n], sum(per.values()), SHA(",".join(map(str, cs[n])))) for (i, _), (d, n) in zip(good, last)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, _x int")


def planted(n, centres=5, spread=0.2, scale=1.0):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(centres, 64)) * scale
    return [(i, [float(np.float32(x)) for x in base[rng.integers(centres)] + rng.normal(size=64) * spread * scale]) for i in range(n)]


def odd(v):
    return [
        (900, None), (901, []), (902, v[:63]), (903, [None] + v[1:]), (904, [float("nan")] + v[1:]), (905, [float("-inf")] + v[1:]),
        (906, v), (907, v), (907, v), (None, v), (None, [x / 2 for x in v]), (908, [0.0] * 64), (909, [-x for x in v]),
    ]


@pytest.mark.parametrize("rows", [planted(300) + odd(planted(300)[0][1]), planted(5), odd([0.5] * 64)[6:9], planted(60, scale=2000.0)], ids=["many", "few", "equal", "large"])
def test_like_plain(spark, rows):
    got = sorted((tuple(r) for r in P.cluster(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert got == plain(rows)


def test_nothing_kept(spark):
    df = frame(spark, odd([1.0] * 64)[:6])
    for empty in (df, df.limit(0)):
        out = P.cluster(empty)
        assert out.count() == 0 and out.columns == P.cluster(frame(spark, planted(3))).columns


def test_sums_over_64_bits_are_null(spark):
    rows = [(i, [1e7 * (-1) ** i] * 64) for i in range(20)] + [(i, [0.0] * 64) for i in range(20, 30)]
    out = P.cluster(frame(spark, rows), k=1).collect()
    assert len(out) == 30 and all(r.inertia is None for r in out)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 6), st.integers(0, 2**32 - 1), st.sampled_from([1, 50, 10**6, 1 << 40]))
def test_bounds_are_below(dim, seed, size):
    rng = np.random.default_rng(seed)
    make = lambda n: rng.integers(-size, size + 1, (n, dim))
    x, c, p = make(40), make(5), make(4)
    x[:5], c[0] = c, p[0]
    pairs = P.choose_pairs(p)
    at = lambda rows: P.root_interval(np.stack([P.squared(rows, q[None, :]) for q in p], axis=1))
    low = P.lower_bounds(at(x), at(c), pairs)
    for i in range(len(x)):
        for j in range(len(c)):
            assert low[i, j] <= float(int(P.squared(x[i : i + 1], c[j : j + 1])[0])) * (1 + 1e-15)
    own, best, _ = P.assign(x, at(x), c, p, pairs)
    exact = [[int(d) for d in P.squared(x, q[None, :])] for q in c]
    want = [min((exact[j][i], j) for j in range(len(c))) for i in range(len(x))]
    assert [(int(d), int(o)) for d, o in zip(best, own)] == want


def test_bounds_prune():
    rows = np.floor(1024 * np.array([v for _, v in planted(2000, centres=8, spread=0.3)])).astype(np.int64)
    p = rows[:8]
    c = rows.reshape(8, -1, 64).mean(1).astype(np.int64) // 4 + p * 3 // 4  # centroids that moved away from the pivots
    cached = P.root_interval(np.stack([P.squared(rows, q[None, :]) for q in p], axis=1))
    own, best, checked = P.assign(rows, cached, c, p, P.choose_pairs(p))
    exact = np.stack([P.squared(rows, q[None, :]) for q in c], axis=1)
    assert (own == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert checked < 0.6 * exact.size
