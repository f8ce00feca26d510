"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other. Small
transducers over these symbols each give a factor at insults and threats, from
whether somebody is addressed, whether a negation stands shortly before, and
whether the clause reports what others said. Their composition walks each clause
once. What a document gets is a logistic function of its clauses' sums.

Insults and their weights are learned: words and word beginnings whose share of
toxic documents is high over enough unlike documents. Threats, targets, negations
and verbs of saying are short fixed lists.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import map_texts, release, store, words

#: Bound of the labelled rows that are fitted on, of the lexicon, and of word beginnings in letters.
FIT_ROWS, LEXICON, STEM = 20_000, 5_000, 4
#: A word may be an insult if so many unlike toxic documents have it and they are this share of all that do;
#: it is common if this share of the toxic documents have it; and the chance left of any false one.
SPREAD, PURITY, COMMON, CHANCE = 2, 0.8, 0.05, 0.05
THRESHOLD = 0.7
#: Words in a run by which documents are told to be alike while fitting.
RUN = 5
_BLOCK = 1 << 20

# Function words of the four languages, by class.
CLASSES = {
    "threat": "kill hurt destroy beat burn töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yours yourself he she they them du dich dir ihr euch tu toi te vous ils elle usted ustedes ellos",
    "negation": "not no never none nobody neither nicht kein keine nie pas jamais aucun sans nunca jamás ningún",
    "report": "said says wrote writes claims claimed called sagte sagt schrieb behauptet dit disait écrit dijo dice escribió",
}
_SYMBOLS = {w: (k, 1.0) for k, ws in CLASSES.items() for w in ws.split()}
_TOKEN = re.compile(r"[^\W\d_]+|[.;:!?\n]|[\"“”„«»]")
_LETTERS = r"[^\p{L}]+"


@dataclass(frozen=True)
class Machine:
    """A transducer: ``arcs[state, symbol]`` is the next state, ``gains[state, symbol]`` a factor (else 1).

    A symbol without an arc goes to ``back`` of the state, or leaves it as it is.
    """

    arcs: dict
    gains: dict = field(default_factory=dict)
    back: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), self.back.get(state, state)), self.gains.get((state, symbol), 1.0)


class Composed(Machine):
    """Both machines at once; the factors multiply. States are made when met."""

    def __init__(self, a: Machine, b: Machine):
        super().__init__({}, {}, {}, (a.start, b.start))
        object.__setattr__(self, "both", (a, b))

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            (x, f), (y, g) = (m.step(s, symbol) for m, s in zip(self.both, state))
            found = self.arcs[state, symbol] = ((x, y), f * g)
        return found


#: Somebody is addressed in the clause: insults weigh more, threats count in full.
TARGETED = Machine({(0, "target"): 1}, {(1, "insult"): 1.3, (0, "threat"): 0.2})
#: Up to three symbols after a negation.
NEGATED = Machine(
    {(s, "negation"): 3 for s in range(4)}, {(s, k): 0.4 for s in (1, 2, 3) for k in ("insult", "threat")}, {3: 2, 2: 1, 1: 0, 0: 0}
)
#: After a verb of saying or inside quotation marks.
REPORTED = Machine(
    {(0, "report"): 1, (0, "quote"): 2, (1, "quote"): 2, (2, "quote"): 0}, {(s, k): 0.6 for s in (1, 2) for k in ("insult", "threat")}
)


def grammar() -> Machine:
    return Composed(Composed(TARGETED, NEGATED), REPORTED)


@dataclass
class Model:
    insults: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def clauses(self, text: str | None, machine: Machine) -> tuple[float, float, float]:
        """Sum, largest and spread of the clause scores of a text."""
        symbols = _SYMBOLS
        total = top = 0.0
        hits = 0
        step, state, here = machine.step, machine.start, 0.0
        for block in _pieces(text or ""):
            for token in _TOKEN.findall(block):
                w = token.lower()
                found = symbols.get(w)
                if found is None:
                    gain = self.insults.get(w) or self.stems.get(w[:STEM])
                    if gain:
                        found = ("insult", gain)
                    elif len(w) == 1 and not w.isalpha():
                        if w in ".;:!?\n":
                            total, top, hits = total + here, max(top, here), hits + (here > 0)
                            state, here = machine.start, 0.0
                            continue
                        found = ("quote", 0.0)
                    else:
                        found = ("other", 0.0)
                state, factor = step(state, found[0])
                if found[0] in ("insult", "threat"):
                    here += factor * found[1]
        return total + here, max(top, here), float(hits + (here > 0))

    def features(self, text: str | None, machine: Machine) -> tuple[float, ...]:
        total, top, hits = self.clauses(text, machine)
        return 1.0, math.log1p(total), math.log1p(top), math.log1p(hits)

    def score(self, text: str | None, machine: Machine) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text, machine)))
        return 1.0 / (1.0 + math.exp(-min(max(z, -30.0), 30.0)))


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces, cut at white space."""
    at = 0
    while len(text) - at > _BLOCK:
        cut = re.compile(r"\s").search(text, at + _BLOCK)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon and weights from at most ``FIT_ROWS`` labelled rows that aren't held out, taken by hash order.

    Rows without key, label or text aren't learned from. Without toxic rows the
    lexicon is empty and every score is low.
    """
    marked = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).filter("_k is not null and _y is not null").filter(~held_out(F.col("_k")))
    marked = marked.orderBy(F.xxhash64("_k"), "_k", "_y").limit(FIT_ROWS)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null")
    # the marked rows are FIT_ROWS pairs of numbers at most, which bounds what is broadcast
    rows = store(texts.join(F.broadcast(marked), "_k").select("_y", "_t", words(F.col("_t")).alias("_w")).select("_y", alike("_w").alias("_like"), "_t"))
    word = F.explode(F.array_distinct(F.split(F.lower("_t"), _LETTERS)))
    found = rows.select("_y", "_like", word.alias("w")).filter("w <> ''")
    toxic = rows.filter("_y = 1").select("_like").distinct().count()
    explained: set = set()
    insults = _choose(found, toxic, explained)
    known = list(insults) + list(_SYMBOLS)
    rest = found.filter(~F.col("w").isin(known) & (F.length("w") >= STEM)).withColumn("w", F.substring("w", 1, STEM))
    model = Model(insults, _choose(rest, toxic, explained))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = grammar()
        for b in batches:
            f = np.array([shared.value.features(t, machine) for t in b["_t"]]).reshape(-1, 4)
            yield pd.DataFrame({"y": b["_y"], "a": f[:, 1], "b": f[:, 2], "c": f[:, 3]})

    x = rows.select(F.col("_y").cast("long").alias("_y"), "_t").mapInPandas(measure, "y long, a double, b double, c double").toPandas()
    release(rows)
    model.weights = _logistic(np.column_stack([np.ones(len(x)), x[["a", "b", "c"]]]), x["y"].to_numpy() == 1)
    return model


def alike(ws: str) -> Column:
    """Smallest hash of the runs of ``RUN`` words of a whole text: near copies mostly share it, unlike texts don't."""
    last = F.greatest(F.size(ws) - (RUN - 1), F.lit(1))
    return F.array_min(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, RUN)))))


def _choose(found: DataFrame, toxic: int, done: set) -> dict[str, float]:
    """Words of the fitted rows to keep, with weights: pure ones that are common or explain unexplained documents.

    By falling count, a word stays if ``COMMON`` of the toxic documents have it
    or if it explains ``SPREAD`` that no word before it does. Words that merely
    stand beside insults in copied documents do neither. What the kept words
    explain is added to ``done``. Like documents with both labels count for both.
    """
    share = found.select("_like", "_y").distinct().agg(F.avg("_y")).first()[0]
    if not share or share >= 1:
        return {}
    per_doc = found.select("w", "_like", "_y").distinct()
    counts = store(per_doc.groupBy("w").agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n")))
    need = (math.log(counts.count()) + math.log(1 / CHANCE)) / -math.log(share)
    pure = counts.filter((F.col("bad") - 2 * (F.col("n") - F.col("bad")) >= need) & (F.col("bad") >= PURITY * F.col("n"))).orderBy(F.desc("bad"), "w").limit(LEXICON)
    bad = {r["w"]: r["bad"] for r in pure.collect()}
    release(counts)
    where: dict[tuple, set] = {}
    for r in found.filter((F.col("_y") == 1) & F.col("w").isin(list(bad))).select("w", "_like").distinct().collect() if bad else []:
        where.setdefault((-bad[r["w"]], r["w"]), set()).add(r["_like"])
    kept = {}
    for (fewer, w), docs in sorted(where.items(), key=lambda x: x[0]):
        if -fewer >= COMMON * toxic or len(docs - done) >= SPREAD:
            kept[w] = math.log2(1 - fewer)
            done |= docs
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, ...]:
    """Newton's rounds with a little shrinkage; rows of either class weigh alike in sum."""
    if not y.any() or y.all():
        return (-3.0, 1.0, 0.0, 0.0)
    w = np.zeros(x.shape[1])
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) / len(x) - 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(x.shape[1])
        w = w + np.linalg.solve(bend, slope)
    return tuple(map(float, w))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted per row; the score sees nothing but the text.

    Null texts count as empty ones. Repeated rows are scored each for themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        machine, model = grammar(), shared.value
        return lambda texts: [np.array([model.score(t, machine) for t in texts], float)]

    scored = map_texts(docs, key, text, make, "score double")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels that may be learned from and scores every document."""
    return score(docs, fit(docs, labels))
