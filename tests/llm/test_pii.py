"""Personal data against a plain search, on texts with few, many and very many spans."""

import random
import re

import pytest

from cellgrove.llm import pii

# The contract's shapes.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


CHECKS = {
    "email": lambda v: True,
    "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
    "card": luhn,
    "phone": lambda v: 10 <= sum(c.isdigit() for c in v) <= 15,
}


def plain(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(SHAPES.items()) for m in re.finditer(p, text) if CHECKS[k](m.group())]
    return sorted(found)


def parts(rng):
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    body = digits(15)
    card = next(body + d for d in "0123456789" if luhn(body + d))
    return ["a.b@c.de", "é🎉x@y.z.w", card, f"+1 ({digits(3)}) {digits(4)}-{digits(4)}", f"{digits(2)}.{digits(3)}.1.{digits(1)}", "+49 10.1.2.3 5555 66", "🎉", "plain words", "\n", digits(5), "@", "+", "-"]


def texts(seed=3):
    rng = random.Random(seed)
    out = ["", "a@b.c", "x" * 3000 + "1.2.3.4"]
    for n in [3] * 60 + [700] * 6:
        out.append(rng.choice(["", " ", ", "]).join(rng.choice(parts(rng)) for _ in range(n)))
    out.append(" ".join(f"u{i}@h.io" for i in range(512)))
    out.append("1.1.1.1 " * 256)
    return out


def redacted(text, spans):
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("block,piece", [(256, 1024), (3, 7)])
def test_spans_and_redaction(spark, monkeypatch, block, piece):
    monkeypatch.setattr(pii, "BLOCK", block)
    monkeypatch.setattr(pii, "PIECE", piece)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in rows:
        spans = [tuple(s.split(":")) for s in got[i].spans.split(",") if s]
        base = [(int(a), pii.BASE.index(k), int(z), k) for k, a, z in spans if k in pii.BASE]
        assert base == plain(t), t[:80]
        ranked = sorted((int(a), [k.name for k in pii.KINDS].index(k_), int(z), k_) for k_, a, z in spans)
        assert clean[i] == redacted(t, ranked)


def test_context_and_ibans(spark):
    valid = "GB82 WEST 1234 5698 7654 32"
    cases = [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", {"iban:5:32"}),
        (f"our partner uses {valid}", {f"iban:17:{17 + len(valid)}"}),
        (f"serial {valid}", set()),
        ("ssn 123-45-6789", {"ssn:4:15"}),
        ("lessness 123-45-6789", set()),
        ("GB82 WEST 1234 5698 7654 33", set()),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.report(df).collect():
        assert {s for s in r.spans.split(",") if s.split(":")[0] in ("iban", "ssn")} == cases[r.doc_id][1], cases[r.doc_id]


def test_a_hundred_thousand_spans(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.org" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.report(df).select("n_email").first()[0] == 100_000
    assert pii.redact(df).first().text == " ".join(["<EMAIL>"] * 100_000)
