"""The audit against a plain version in whole numbers; transducers against sorted lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrove.llm import divergence as D
from cellgrove.llm import transducer as T


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows):
    docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        found = terms_of(text)
        docs[lang or ""].update(set(found))
        counts[lang or ""][source or ""].update(found)
    out = []
    for lang, groups in counts.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= 3), key=str.encode)
        v = len(kept)

        def p_of(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p = {s: p_of(c) for s, c in groups.items()}
        q = p_of(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((-f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            for part, ranked in (("pair", pair), ("term", term[:200])):
                out += [(lang, s, part, item, -val, n + 1) for n, (val, item) in enumerate(ranked)]
    return sorted(out)


def planted():
    rng = random.Random(5)
    vocab = ["Straße", "été", "ÉTÉ", "漢字", "abc", "ABC", "Abd", "z", "don't", "x1y", "ab_c", "�", "🎉", "\x85", "long" * 40, "é" * 50] + [f"w{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = []
    for _ in range(150):
        weights = [rng.random() ** 4 for _ in vocab]
        text = "".join(w + rng.choice(" \n\t.,;0@[`{\x7f\x00") for w in rng.choices(vocab, weights, k=rng.choice([0, 1, 5, 40, 200])))
        rows.append((text, rng.choice(["en", "en", "fr", None, "xx"]), rng.choice(["s1", "s1", "s1", "s2", "é", "Z", None])))
    return [*rows, rows[0], rows[0], (None, "en", "only null"), ("", "fr", "only empty"), ("rare words", "alone", "a"), ("", "alone", "b")]


@pytest.mark.parametrize("head,block", [(1 << 20, 4 << 20), (12, 64), (1, 1000)])
def test_audit(spark, monkeypatch, head, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rows = planted()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = sorted(tuple(r) for r in D.audit(df, head_terms=head).collect())
    assert got == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(df).count() == 0


def test_share_beyond_64_bits(spark):
    n = 10**13
    got = spark.range(1).selectExpr(f"{n}L as n", f"{3 * n}L as t", "7L as v").select(D.share("n", "t", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (3 * n + 7)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text(alphabet="abcé漢", min_size=1, max_size=6), max_size=60), st.lists(st.text(alphabet="abcé漢 ", max_size=8), max_size=40))
def test_transducer(terms, more):
    ordered = sorted(t.encode() for t in terms)
    machine = T.build(ordered)
    text = " ".join([*sorted(terms), *more]).encode()
    starts, lengths = T.stretches(np.frombuffer(text, np.uint8))
    got = machine.ordinals(np.frombuffer(text, np.uint8), starts, lengths)
    found = [text[a : a + n] for a, n in zip(starts, lengths)]
    assert found == [m.group() for m in D._TERM.finditer(text)]
    assert got.tolist() == [ordered.index(f) if f in ordered else -1 for f in found]


def test_transducer_is_minimal():
    ordered = sorted((a + b).encode() for a in ("un", "re", "") for b in ("do", "make", "dos", "makes"))
    machine = T.build(ordered)
    rights = set()  # states of a minimal automaton are the distinct sets of endings

    def endings(prefix):
        return frozenset(w[len(prefix):] for w in ordered if w.startswith(prefix))

    for w in ordered:
        for i in range(len(w) + 1):
            rights.add(endings(w[:i]))
    assert len(machine.final) == len(rights)


def test_blocks_keep_terms_whole():
    text = b"abc def" * 50 + "é".encode() * 100 + b" x"
    for size in (1, 5, 64):
        parts = list(T.blocks(text, size))
        assert b"".join(parts) == text
        assert [t for p in parts for t in D._TERM.findall(p)] == D._TERM.findall(text)
