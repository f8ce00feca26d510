"""SimHash links against all pairs, at sizes where both ways of linking are used."""

import itertools
import random

import pytest
import xxhash

from cellgrove.llm import simhash as S


def roots(fps):
    """Components of all pairs within two bits, by brute force."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in root}


def plain(text):
    """The fingerprint from its definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["", " \t\n", "one", "Two Words", "three words here", "a b c d e f g", "ÄÖ Ä ß É x y z", "same same same same same", "x " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.simhash(text) == plain(text)


def test_null_is_empty():
    assert S.simhash(None) == 0


def check(spark, fps):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    mask = (1 << 64) - 1
    found = {(e.a & mask, e.b & mask) for e in edges}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    want, got = roots(fps), {f: f for f in fps}
    for _ in fps:  # relax until nothing changes
        changed = False
        for a, b in found:
            m = min(got[a], got[b])
            if got[a] != m or got[b] != m:
                got[a] = got[b] = m
                changed = True
        if not changed:
            break
    assert got == want


def test_links_sparse(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randrange(4)):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    check(spark, sorted(fps))


def test_links_crowded(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWDED", 5)
    rng = random.Random(2)
    f = rng.getrandbits(64)
    fps = {f}
    while len(fps) < 300:
        g = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            g ^= 1 << rng.randrange(64)
        fps.add(g)
    check(spark, sorted(fps))


def test_whole_operator(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijk") * 3 for _ in range(80)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, *base, *base, *[b.upper() for b in base]])] + [(None, "one")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, a int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {}
    for k, t in rows:
        fp.setdefault(plain(t or ""), []).append(k)
    root = roots(list(fp))
    for r in got:
        f = int(r.fingerprint, 16)
        same = [k for g, ks in fp.items() if root[g] == root[f] for k in ks if k is not None]
        assert r.doc_id in fp[f] and r.component_id == min(same)
    assert S.near_duplicates(df.limit(0)).count() == 0
