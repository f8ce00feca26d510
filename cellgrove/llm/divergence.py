"""Source divergence audit: how the sources of a language differ in their terms.

Terms of enough documents are kept. From the sorted kept terms of each language a
minimal acyclic transducer is built, whole texts are streamed through it for the
counts of each source, and the terms' lexicographic ordinals stand for them until the
report, also to break ties. All arithmetic is in whole numbers.

A transducer is broadcast, so its size is bounded: it holds at most HEAD_TERMS terms of
up to HEAD_BYTES bytes, the most documented ones. What falls out of it while text
streams is counted by term and joined with the other kept terms, which is exact for
any vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.common import release, store
from cellgrove.llm.transducer import LOWER, Transducer, blocks, build, stretches
from cellgrove.operators.ranking import global_row_number

LEAST_DOCS, UNIT, MOST_RANKS = 3, 1_000_000_000, 200
#: Bounds of all transducers together: terms, and bytes of a term.
HEAD_TERMS, HEAD_BYTES = 1 << 20, 64
#: Bytes of text that are streamed at once.
BLOCK_BYTES = 4 << 20
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = "lang string, source string, ord long, term string, n long"


def _columns(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def kept_terms(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, docs: terms found in at least ``least`` rows of their language.

    Whole texts are read as bytes; each batch gives one row for each of its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), _bytes(b.column(1))):
                once: set[bytes] = set()
                for piece in blocks(text, BLOCK_BYTES):
                    once.update(_TERM.findall(piece.lower()))
                found[lang].update(once)
            for lang, terms in found.items():
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), names, pa.array(list(terms.values()), pa.int64())], ["lang", "term", "docs"])

    each = rows.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)


def transducers(head: DataFrame) -> DataFrame:
    """One transducer a language from lang, term, ord; bounded by the bounds of ``head``."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")  # ordinals are in the terms' order
        t = build(_bytes(table["term"].combine_chunks()))
        parts = [t.keys, t.targets, t.outputs, t.final, table["ord"].to_numpy()]
        return pa.table({"lang": [key[0].as_py()], "root": [t.root], "parts": pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))})

    return head.groupBy("lang").applyInArrow(make, "lang string, root long, parts array<binary>")


def _load(row) -> tuple[Transducer, np.ndarray]:
    keys, targets, outputs, final, ords = (np.frombuffer(p, k) for p, k in zip(row["parts"], (np.int64, np.int32, np.int64, bool, np.int64)))
    return Transducer(keys, targets, outputs, final, row["root"]), ords


def stream_counts(rows: DataFrame, machines: DataFrame, short_rest: bool, long_rest: bool) -> DataFrame:
    """lang, source, ord, term, n: occurrences by ordinal, or by term for those that fell out.

    ``short_rest`` and ``long_rest`` say whether kept terms of up to, and beyond,
    HEAD_BYTES are missing in the transducers; else what falls out isn't kept at all.
    """
    shared = rows.sparkSession.sparkContext.broadcast([(r["lang"], _load(r)) for r in machines.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(shared.value)
        for b in batches:
            sources, texts = b.column(1).to_pylist(), _bytes(b.column(2))
            by_lang: dict[str, list[int]] = defaultdict(list)
            for i, lang in enumerate(b.column(0).to_pylist()):
                by_lang[lang].append(i)
            for lang, at in by_lang.items():
                names = sorted({sources[i] for i in at})
                number = {s: n for n, s in enumerate(names)}
                counts, rest = _count(known.get(lang), [(number[sources[i]], texts[i]) for i in at], short_rest, long_rest)
                found = [(names[g], o, None, n) for (g, o), n in counts] + [(names[g], None, t, n) for (g, t), n in rest.items()]
                if found:
                    source, ord_, term, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(source, pa.string()), pa.array(ord_, pa.int64()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                        ["lang", "source", "ord", "term", "n"],
                    )

    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "ord", "term").agg(F.sum("n").alias("n"))


def _count(machine: tuple[Transducer, np.ndarray] | None, texts: list[tuple[int, bytes]], short_rest: bool, long_rest: bool):
    """Counts by (source number, ordinal), and by (source number, term) of what fell out."""
    sums: Counter = Counter()
    rest: Counter = Counter()

    def flush(block: list[tuple[int, bytes]]) -> None:
        text = LOWER[np.frombuffer(b" ".join(t for _, t in block), np.uint8)]
        starts, lengths = stretches(text)
        ends = np.cumsum([len(t) + 1 for _, t in block])
        owner = np.array([g for g, _ in block])[np.searchsorted(ends, starts, side="right")]
        fits = lengths <= HEAD_BYTES
        place = np.full(len(starts), -1, np.int64)
        if machine is not None:
            place[fits] = machine[0].ordinals(text, starts[fits], lengths[fits])
            hit = place >= 0
            pair, n = np.unique(owner[hit] * len(machine[1]) + place[hit], return_counts=True)
            for g, o, k in zip((pair // len(machine[1])).tolist(), machine[1][pair % len(machine[1])].tolist(), n.tolist()):
                sums[g, o] += k
        out = (place < 0) & ((fits & short_rest) | (~fits & long_rest))
        for g, a, k in zip(owner[out].tolist(), starts[out].tolist(), lengths[out].tolist()):
            rest[g, text[a : a + k].tobytes()] += 1

    block, size = [], 0
    for g, t in texts:
        for piece in blocks(t, BLOCK_BYTES):
            if block and size + len(piece) > BLOCK_BYTES:
                flush(block)
                block, size = [], 0
            block.append((g, piece))
            size += len(piece)
    if block:
        flush(block)
    return sums.items(), rest


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + 1 * kept)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0))")


def pair_sums(terms: DataFrame) -> DataFrame:
    """lang, g, s, value: sums over terms of floor((p-q)^2 / q) for all ordered pairs of sources.

    ``terms`` has a row for each kept term: lang, shares (struct of source number and p,
    for the sources that have it) and absent (p of the other case, by source number).
    A task adds up its terms and gives one row for each pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                mine = b.filter(pa.array(langs == lang))
                absent = np.array(mine.column(2)[0].as_py(), np.int64)
                step = max(1, (1 << 20) // len(absent))
                for at in range(0, len(mine), step):
                    shares = mine.column(1).slice(at, step)
                    p = np.tile(absent, (len(shares), 1))
                    flat = shares.flatten()
                    p[np.repeat(np.arange(len(shares)), shares.value_lengths().to_numpy()), flat.field("g").to_numpy()] = flat.field("p").to_numpy()
                    sums = total.setdefault(lang, np.zeros((len(absent), len(absent)), np.int64))
                    for g in range(len(absent)):
                        d = p[:, g : g + 1] - p
                        sums[g] += (d * d // p).sum(0)
        for lang, sums in total.items():
            n = len(sums)
            g, s = np.divmod(np.arange(n * n), n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (n * n), pa.string()), pa.array(g, pa.int32()), pa.array(s, pa.int32()), pa.array(sums.reshape(-1))], ["lang", "g", "s", "value"])

    return terms.select("lang", "shares", "absent").mapInArrow(run, "lang string, g int, s int, value long").groupBy("lang", "g", "s").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, ranks: int = MOST_RANKS, head_terms: int = HEAD_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: pairs of sources and standing-out terms.

    Null texts, languages and sources count as ''. Terms are runs of letters A-Z, a-z
    and code points beyond ASCII, with only A-Z lower-cased; a language keeps those
    in at least ``least`` of its rows, repeated rows counted each. Part ``pair`` has all
    other sources of the language, also where no term is kept (value 0); part
    ``term`` the first ``ranks`` terms that the source has more often than its language. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = _columns(docs, text, lang, source)
    found = store(kept_terms(rows, least))
    kept = store(global_row_number(found, ["lang", "term"], "ord"))
    short = F.octet_length("term") <= HEAD_BYTES
    size = kept.agg(F.count("*").alias("n"), F.count(F.when(short, 1)).alias("short")).first()
    in_head = short
    if size["short"] > head_terms:
        cut = kept.filter(short).agg(F.percentile_approx("docs", 1 - head_terms / size["short"] * 0.9, 100_000)).first()[0]
        while kept.filter(short & (F.col("docs") > cut)).count() > head_terms:
            cut = 2 * cut + 1  # the quantile is approximate, the bound is not
        in_head = short & (F.col("docs") > cut)
    machines = transducers(kept.filter(in_head).select("lang", "term", "ord"))
    counted = store(stream_counts(rows, machines, size["short"] > head_terms, size["n"] > size["short"]))
    fell = counted.filter("term is not null").select("lang", "source", "term", "n").join(kept.filter(~in_head).select("lang", "term", "ord"), ["lang", "term"])
    counts = counted.filter("ord is not null").select("lang", "source", "ord", "n").unionByName(fell.select("lang", "source", "ord", "n"))

    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = store(groups.select("lang", "source", none("total"), none("v"), number.alias("g")))

    shares = counts.join(groups, ["lang", "source"]).select("lang", "ord", "g", "n", share("n", "total", "v").alias("p"))
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("total"), F.first("v").alias("v"),
        F.transform(F.array_sort(F.collect_list(F.struct("g", F.when(F.col("v") > 0, share("0L", "total", "v")).alias("p")))), lambda x: x["p"]).alias("absent"),
    )
    terms = shares.groupBy("lang", "ord").agg(F.sum("n").alias("n"), F.collect_list(F.struct("g", "p")).alias("shares"))  # at most one entry for each source
    terms = store(terms.join(langs, "lang").select("lang", "ord", "shares", "absent", share("n", "total", "v").alias("q")))

    a, b = groups.select("lang", "source", "g"), groups.select("lang", F.col("source").alias("item"), F.col("g").alias("s"))
    pairs = a.join(b, "lang").filter("g <> s").join(pair_sums(terms), ["lang", "g", "s"], "left")
    best = lambda *tie: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), *tie))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", none("value")).withColumn("rank", best("item"))

    more = terms.select("lang", "ord", "q", F.explode("shares").alias("x")).select("lang", "ord", "q", "x.g", "x.p").filter("p > q")
    more = more.join(groups.select("lang", "g", "source"), ["lang", "g"]).selectExpr("lang", "source", "ord", "(p - q) * (p - q) div q as value")
    top = more.withColumn("rank", best("ord")).filter(F.col("rank") <= ranks)
    top = top.join(kept.select("ord", F.col("term").alias("item")), "ord")
    release(found)
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def audit_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, over whole texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with d as (select row_number() over () as rid, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from {table}),
w as (select rid, lang, source, unnest(regexp_extract_all(translate(t, '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from w group by all having count(distinct rid) >= {LEAST_DOCS}),
v as (select lang, count(*)::hugeint as v from k group by all),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from w join k using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
gp as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) as p
  from gn join k on k.lang = gn.lang join v on v.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
lp as (select lang, term, 1 + ({UNIT}::hugeint * (n + 1)) // (sum(n) over (partition by lang) + v) as q
  from (select c.lang, c.term, sum(c.n)::hugeint as n, any_value(v.v) as v from c join v using (lang) group by all)),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select gp.lang, gp.source, 'term' as part, gp.term as item, (p - q) * (p - q) // q as value
  from gp join lp on lp.lang = gp.lang and lp.term = gp.term where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {MOST_RANKS}"""
