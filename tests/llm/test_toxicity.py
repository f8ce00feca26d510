"""Toxicity: the composed grammar against a plain walk, and held-out figures on planted clauses."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellgrove.llm import toxicity as T

INSULTS = ["blorft", "grubnak", "snivvel", "drazzik"]


def plain(text, insults):
    """Clause sums told without states: counts back from each word inside its clause."""
    sums = []
    for clause in re.split(r"[.;:!?\n]", text):
        tokens = re.findall(r'\w+|"', clause)
        kinds = [T._SYMBOLS.get(w, ("insult", insults[w]) if w in insults else ("other", 0.0)) for w in map(str.lower, tokens)]
        total = 0.0
        for i, (kind, weight) in enumerate(kinds):
            if kind not in ("insult", "threat"):
                continue
            before = [k for k, _ in kinds[:i]]
            addressed = "target" in before
            negated = "negation" in before[-3:]
            quotes = [j for j in range(i) if tokens[j] == '"']
            reported = len(quotes) % 2 == 1 or "report" in before[quotes[-1] if quotes else 0 :]
            factor = (1.3 if addressed else 1.0) if kind == "insult" else (1.0 if addressed else 0.2)
            total += weight * factor * (0.4 if negated else 1.0) * (0.6 if reported else 1.0)
        sums.append(total)
    return sum(sums), max(sums), float(sum(s > 0 for s in sums))


def test_grammar_like_a_plain_walk():
    rng = random.Random(8)
    insults = {w: 1.0 + i for i, w in enumerate(INSULTS)}
    model = T.Model(insults, {})
    pool = [*INSULTS, "kill", "hurt", "you", "they", "not", "never", "said", "writes", "calm", "tree", "river", "stone", '"', ".", "!", "\n"]
    for _ in range(500):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        assert model.clauses(text, T.grammar()) == pytest.approx(plain(text, insults)), text


def corpus(seed=5, n=1500):
    """Every tenth document is toxic; a third of all begin with one header of 60 characters."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 9))) for _ in range(400)] + ["you"] * 20
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(20, 120))
        toxic = i % 10 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), f"you {rng.choice(INSULTS)}!")
        header = "this header stands before a third of all the documents here " if i % 3 == 0 else ""
        rows.append((i, header + " ".join(words), int(toxic)))
    return rows


def test_fit_and_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", "d") for i, t, _ in rows] + [(None, "x", "c", "d"), (9_000, None, "c", "d"), (9_001, "", "c", "d")], "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None), (9_000, 1), (77_777, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert set(model.insults) == set(INSULTS)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 300 and [i for i in held if got[i].predicted != truth[i]] == []
    assert got[None].predicted == got[9_000].predicted == got[9_001].predicted == 0
    assert T.score(docs.limit(0), model).count() == 0
    assert T.fit(docs, labels.limit(0)).insults == {} == T.fit(docs.limit(0), labels).insults


def test_alike_reads_whole_texts(spark):
    start = "one beginning that is far longer than forty characters in every text "
    texts = [start + "alpha beta gamma delta epsilon zeta", start + "red green blue black white grey", "", "word", "word"]
    hashes = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("w")).select(T.alike("w").alias("h")).collect()]
    assert hashes[3] == hashes[4] and hashes[2] != hashes[3] and None not in hashes
