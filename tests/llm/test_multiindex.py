"""Embedding links against all pairs."""

import math
import random

import numpy as np
import pytest

from cellgrove.llm import multiindex as M


def brute(rows):
    """n_links and component of each row, from the definition."""
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = {i: set() for i, _, _ in rows}
    ok = [(i, v, lab) for i, v, lab in rows if lab is not None and good(v)]
    for a, (i, v, x) in enumerate(ok):
        for j, w, y in ok[a + 1 :]:
            if x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def planted(n=400, dim=16):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    while i < n:
        base = rng.normal(size=dim)
        for _ in range(random.Random(i).choice([1, 1, 2, 40])):
            noise = rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.2])
            rows.append((i, [float(np.float32(x)) for x in base + noise], int(rng.integers(3))))
            i += 1
    odd = [None, [0.0] * dim, [1.0, None] + [1.0] * (dim - 2), [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, []]
    rows += [(i + k, v, 0) for k, v in enumerate(odd)] + [(i + 10, rows[0][1], None), (i + 11, rows[0][1][:8], 0), (i + 12, rows[0][1][:8], 0)]
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in M.near_duplicates(df, recall=1.0).collect()}
    assert got == brute(rows)


def test_traversal_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    want = sorted((x + y, i * 9 + j) for i, x in enumerate(a) for j, y in enumerate(b) if x + y <= 0.7)
    assert M.traverse(a, b, 0.7) == [c for _, c in want]


def test_empty(spark):
    assert M.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
