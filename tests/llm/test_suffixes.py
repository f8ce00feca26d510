"""Repeated strings against a table of all strings of the length."""

import random
from collections import Counter

import pytest

from cellgrove.llm import suffixes as S


def brute(texts):
    seen = Counter()
    raw = [t.encode() for t in texts]
    for t in raw:
        for i in range(len(t) - S.LENGTH + 1):
            seen[t[i : i + S.LENGTH]] += 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - S.LENGTH + 1):
            if seen[t[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(rng.randrange(40, 90)) for _ in range(6)]
    texts = ["", "x" * 1000, "ab" * 150, "y" * 199, "y" * 200, "z" * 200, "z" * 200, prose(60) + "\n" + prose(60)]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(shared)[rng.randrange(30) :][: rng.randrange(150, 400)] if rng.random() < 0.4 else prose(rng.randrange(5, 80)))
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [t for t in texts if rng.random() < 0.2]
    for t in [t for t in texts if len(t) > 300][:20]:
        i = rng.randrange(len(t))
        texts.append(t[:i] + "#" + t[i + 1 :])
    return texts


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_remove(spark, monkeypatch, seed, small):
    if small:  # many runs, ranges and blocks
        for name, value in (("RUN", 50), ("RANGE", 40), ("BLOCK", 7), ("_PIECE", 450)):
            monkeypatch.setattr(S, name, value)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, at string").repartition(5)
    got = {r.doc_id: (sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in S.remove(df).collect()}
    want = brute(texts)
    bad = [i for i, w in enumerate(want) if got[i] != w[1:]]
    assert not bad, (len(bad), [(i, got[i][:2], want[i][:3]) for i in bad[:5]])


def test_loser_tree():
    rng = random.Random(3)
    runs = [sorted({bytes(rng.choices(b"ab", k=rng.randrange(9))) for _ in range(30)}) for _ in range(5)]
    coded = [iter([(s, S.shared(r[i - 1], s) if i else 0, b"") for i, s in enumerate(r)]) for r in runs]
    out = list(S.LoserTree(coded))
    assert [s for s, _, _ in out] == sorted(s for r in runs for s in r)
    assert [k for _, k, _ in out[1:]] == [S.shared(a[0], b[0]) for a, b in zip(out, out[1:])]


def test_odd_rows(spark):
    long = "repeat " * 60
    rows = [(1, long), (1, "other"), (None, long), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in S.report(df).collect())
    n = len(long)
    assert got == sorted([("1", n, n), ("1", 5, 0), ("None", n, n), ("None", 0, 0), ("2", 0, 0)])
    assert S.report(df.limit(0)).count() == 0


def test_keys_null_equal_and_beyond_doubles(spark):
    """Rows are known by their text alone: no key leaks into what goes, and none changes on its way."""
    rng = random.Random(9)
    prose = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(k))
    shared, big = prose(80), 2**53 + 1
    rows = [(big, prose(30) + shared), (None, shared + prose(30)), (None, prose(70)), (None, prose(70)), (7, prose(70)), (7, prose(70)), (big, shared)]
    rows += [(None, rows[2][1][:260] + prose(40))] + [(None, "hot copy " * 40)] * 50
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in S.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = brute([t for _, t in rows])
    assert got == sorted((str(k), *w[:3]) for (k, _), w in zip(rows, want))
