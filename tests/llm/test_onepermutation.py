"""Fingerprints against a plain Python version, and neighbours across runs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cellgrove.llm import onepermutation as O

MD5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def plain(text):
    """The fingerprint from its definition: least hash of a bin, empty bins by the family's ranks."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    hashes = [MD5(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))] if w else []
    least = {}
    for h in hashes:
        b = int(h[:2], 16)
        least[b] = min(h, least.get(b, h))
    if not least:
        return "-" * 256
    pick = lambda j: least[min(least, key=lambda b: (b * (j * 167 % 256 + 1) + (j * j * 91 + j * 57 + 29) % 257) % 257)]
    return "".join((least[j] if j in least else pick(j))[-1] for j in range(256))


def near(a, b):
    m = sum(x == y for x, y in zip(a, b))
    return max(0.0, (m * 16 - 256) / 3840)


def want(rows):
    """Contract rows from the definition, neighbours by falling key and MD5."""
    docs = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), MD5(r[1])))
    out = []
    for i, (k, t) in enumerate(docs):
        nt = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nt[:h]
        f, ef = plain(t), plain(e)
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), f, ef, near(f, ef), near(f, plain(nt))))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice(["wort", "é", "漢字 ", "ab", "c"]) + rng.choice(" \t\n\x0b\x1c") for _ in range(n))
    some = [(i * 7 - 50, text(rng.choice([1, 3, 5, 9, 60, 400, 3000]))) for i in range(40)]
    same = some[0][1]
    return [*some, (400, same), (401, None), (402, ""), (403, " \n"), (None, "no key"), (None, None), (None, "no key"), (5, same), (5, same), (5, "other")]


@pytest.mark.parametrize("run_rows", [4096, 5, 1])
def test_report(spark, run_rows):
    data = rows() + [(77, f"hot {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in data], "doc_id long, text string, fingerprint string, _t string").repartition(3)
    got = sorted((tuple(r) for r in O.report(df, run_rows=run_rows).collect()), key=repr)
    assert got == want(data)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(3, "one text of more than five words here")], "doc_id long, text string")
    assert O.report(df.limit(0)).count() == 0
    assert [tuple(r) for r in O.report(df).collect()] == want([(3, "one text of more than five words here")])


def test_runs_split_a_hot_key(spark):
    df = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("s"))
    sizes = df.groupBy(O.runs(df, "k", 100)(F.col("k"), F.col("s")).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) < 250


def test_likeness_follows_jaccard(spark):
    rng = random.Random(4)
    pairs = []
    for share in (0.05, 0.3, 0.5, 0.8, 0.95):
        for n in (60, 500, 5000):
            w = [f"w{rng.random()}" for _ in range(n)]
            cut = int(n * share)
            v = w[:cut] + [f"v{rng.random()}" for _ in range(n - cut)]
            a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (w, v))
            pairs.append((" ".join(w), " ".join(v), len(a & b) / len(a | b)))
    df = spark.createDataFrame(pairs, "a string, b string, j double")
    got = df.select("j", O.likeness(O.fingerprint(F.col("a")), O.fingerprint(F.col("b"))).alias("e")).collect()
    assert max(abs(r.j - r.e) for r in got) < 0.15
    assert sum(r.e - r.j for r in got) / len(got) < 0.03
