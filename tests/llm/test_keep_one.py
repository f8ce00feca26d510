"""keep_one against the exact similarity of all pairs, on copies that differ by added, missing and changed text."""

import random

import numpy as np
import pytest

from cellgrove.llm import simhash as S


def shingles(text, size=5):
    w = text.lower().split()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def copies(n=60):
    """Pairs of a text and a longer, cut or edited copy, all of them behind one passage."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(20000)}"
    header, rows = [word() for _ in range(12)], []
    for k in range(n):
        base = header + [word() for _ in range(rng.randrange(100, 600))]
        share = rng.choice([0.05, 0.1, 0.13, 0.15])
        if k % 3 == 0:
            other = base + [word() for _ in range(int(share * len(base)))]
        elif k % 3 == 1:
            other = base[: int(len(base) * (1 - share))]
        else:
            other = [word() if rng.random() < 0.015 else w for w in base]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("small", [24, 2])
def test_added_and_missing_text(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rows = copies()
    kept = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    alike = {(i, j): s for i in range(len(sets)) for j in range(i) if (s := jaccard(sets[i], sets[j])) > 0.5}
    assert set(alike) <= {(2 * k + 1, 2 * k) for k in range(len(rows) // 2)}
    near = {i for (i, _), s in alike.items() if s >= 0.84}  # clear of the fingerprints' own error
    assert len(near) > 40 and not kept & near
    assert {2 * k for k in range(len(rows) // 2)} <= kept


def test_prefix_keys_miss_nothing():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n, lost, new = int(rng.integers(1, 300)), int(rng.integers(0, 40)), int(rng.integers(0, 40))
        pool = np.unique(rng.integers(1, 1 << 62, n + new).astype(np.uint64))
        a, b = pool[:n], pool[min(lost, n - 1) :]
        common = np.unique(rng.choice(pool, len(pool) // 2))
        counts = rng.integers(3, 9, len(common))
        if jaccard(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert set(S.prefix_keys(a, 0.8, common, counts).tolist()) & set(S.prefix_keys(b, 0.8, common, counts).tolist())


def test_every_row_counts_towards_the_order_of_keys(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(700)] + ["a a a a a a a a"] * 40 + [None, ""]
    want = np.zeros(S.BUCKETS, np.int64)
    for t in texts:
        want[[int(h) % S.BUCKETS for h in S.shingle_hashes(t)]] += 1
    df = spark.createDataFrame([(t,) for t in texts], "_t string")
    for parts in (1, 7):
        assert (S.bucket_counts(df.repartition(parts), 5) == want).all()
    assert want.max() >= 40
