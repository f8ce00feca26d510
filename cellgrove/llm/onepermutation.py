"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once (MD5). The first two hex digits say the bin,
the least hash of a bin represents it, and its last hex digit, four low-order bits,
is kept: 256 digits a document. An empty bin takes the digit of a filled one that a
2-universal family, with a member for each bin, ranks first (optimal densification),
so that empty bins choose independently and equally in all documents. The share of
equal digits overstates the likeness by chance hits of one in sixteen; ``likeness``
corrects that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.llm.common import store, words

SHINGLE = 5
#: Two hex digits name a bin and one digit is kept of it.
BINS, VALUES = 256, 16
#: Least prime above the bins, for the rank of filled bins.
PRIME = 257
#: Rows of a run of neighbouring documents, and the most borders between runs.
RUN_ROWS, MOST_BORDERS = 4096, 4096
_NO_KEY = -(1 << 63)

#: Member j of the family ranks the filled bin b by (a * b + c) mod 257; both by rule.
_A = [j * 167 % BINS + 1 for j in range(BINS)]
_C = [(j * j * 91 + j * 57 + 29) % PRIME for j in range(BINS)]
#: The bins of the first ranks, looked at one by one before all filled ones are ranked.
_PROBES = [[(r - c) * pow(a, -1, PRIME) % PRIME for a, c in zip(_A, _C)] for r in range(8)]


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(text: Column) -> Column:
    """Sorted hashes of all shingles; a text of fewer words is one shingle, without words none."""

    def cut(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.md5(F.concat_ws(" ", F.slice(w, i, SHINGLE))))
        few = F.when(F.size(w) > 0, F.array(F.md5(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= SHINGLE, F.sort_array(each)).otherwise(few)

    return _bind(words(text), cut)


def fingerprint(text: Column) -> Column:
    """256 hex digits; null, empty and blank texts give 256 dashes."""
    bin_of = lambda h: F.substring(h, 1, 2)
    least = _bind(_hashes(text), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))
    bins_of = F.sequence(F.lit(0), F.lit(BINS - 1))

    def fill(own: Column) -> Column:
        slots = F.transform(bins_of, lambda j: F.get(own["digits"], F.array_position(own["bins"], j).cast("int") - 1))

        def digits(slots: Column) -> Column:
            def digit(j: Column) -> Column:
                rank = lambda b, at: (b * F.get(F.lit(_A), j) + F.get(F.lit(_C), j)) % PRIME * BINS + at
                ranked = F.array_min(F.transform(own["bins"], rank))
                return F.coalesce(F.get(slots, j), *[F.get(slots, F.get(F.lit(p), j)) for p in _PROBES], F.get(own["digits"], ranked % BINS))

            return F.array_join(F.transform(bins_of, digit), "")

        return _bind(slots, digits)

    split = lambda s: F.struct(
        F.transform(s, lambda h: F.conv(bin_of(h), 16, 10).cast("int")).alias("bins"), F.transform(s, lambda h: h.substr(-1, 1)).alias("digits")
    )
    return _bind(least, lambda s: F.when(F.size(s) == 0, F.lit("-" * BINS)).otherwise(_bind(split(s), fill)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: the share of equal digits without the chance hits."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))))
    return F.greatest(F.lit(0.0), (same * VALUES - BINS).cast("double") / float(BINS * (VALUES - 1)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and fingerprint per row. Only the two columns are read."""
    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).select(F.col("_k").alias(key), fingerprint(F.col("_t")).alias("fingerprint"))


def _count(borders: list[int], holds: Callable[[Column], Column]) -> Column:
    """How many leading entries of the falling ``borders`` hold, in two steps of at most 64 comparisons."""
    every = F.array(*[F.lit(b) for b in borders])
    heads = F.size(F.filter(F.array(*[F.lit(b) for b in borders[::64]]), holds))
    within = _bind(heads, lambda c: F.when(c == 0, 0).otherwise((c - 1) * 64 + F.size(F.filter(F.slice(every, (c - 1) * 64 + 1, 64), holds))))
    return within.cast("long")


def runs(keys: DataFrame, key: str, run_rows: int = RUN_ROWS) -> Callable[[Column, Column], Column]:
    """A function of key and digest that gives the number of a row's run.

    Runs follow each other by falling key and hold about ``run_rows`` rows, more
    in tables of over ``run_rows * MOST_BORDERS`` rows. A key that would fill
    several runs by itself is split by the digest. The borders are approximate
    quantiles; they set the balance, not the result.
    """
    rows = keys.count()
    n = min(rows // run_rows, MOST_BORDERS)
    if n == 0:
        return lambda k, s: F.lit(0).cast("long")
    at = F.percentile_approx(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)), [(i + 1) / (n + 1) for i in range(n)], 8 * MOST_BORDERS)
    borders = sorted(keys.agg(at).first()[0], reverse=True)

    def run(k: Column, s: Column) -> Column:
        value = F.coalesce(k.cast("long"), F.lit(_NO_KEY))
        above, least = _count(borders, lambda b: b > value), _count(borders, lambda b: b >= value)
        share = F.conv(F.substring(s, 1, 4), 16, 10).cast("long")

        def number(c: Column) -> Column:
            own = c["least"] - c["above"]
            part = F.floor(share * own / 65536).cast("long")
            return F.when(own >= 2, (c["above"] * 2 + 1) * 65536 + part).otherwise(c["least"] * 2 * 65536)

        return _bind(F.struct(above.alias("above"), least.alias("least")), number)

    return run


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited form, with their likeness.

    ``key`` (a whole number), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, one row per input row. The edited text has its last floor(n_chars / 2)
    code points replaced by the first as many, or all, of the next document's. The
    next document is the one of the next smaller key; rows of equal key follow each
    other by MD5 of their texts, rows without key come last, and after the last comes
    the first. A single row is its own next. Null texts count as empty; an empty table
    gives an empty result. Other columns are not read.

    Whole texts are shuffled once, by runs of neighbouring documents. Only the
    last row of a run has its next one elsewhere: for the two rows at each border
    texts are stored, and those meet in a second, small step.
    """
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    run = runs(rows.select("_k"), "_k", run_rows)
    rows = rows.select("_k", "_t", F.md5("_t").alias("_s"), fingerprint(F.col("_t")).alias("_f"))
    rows = rows.select("*", run(F.col("_k"), F.col("_s")).alias("_run"))
    order = Window.partitionBy("_run").orderBy(F.col("_k").desc_nulls_last(), "_s")
    rows = rows.select("*", F.lead("_t").over(order).alias("_nt"), F.lead("_f").over(order).alias("_nf"), F.row_number().over(order).alias("_at"))

    def edit(t: DataFrame) -> DataFrame:
        n = F.length("_t")
        half = F.floor(n / 2).cast("int")
        # concat is null where the next text is not known yet
        t = t.select("*", F.concat(F.left("_t", n - half), F.left("_nt", half)).alias("_e"))
        return t.select("*", n.cast("long").alias("_n"), F.sha2(F.col("_e").cast("binary"), 256).alias("_es"), F.when(F.col("_e").isNotNull(), fingerprint(F.col("_e"))).alias("_ef"))

    done = ["_k", "_n", "_es", "_f", "_ef", "_nf"]
    last, first = F.col("_nt").isNull(), F.col("_at") == 1
    known = store(edit(rows).select(*done, "_run", F.when(last, F.col("_t")).alias("_last"), F.when(first, F.col("_t")).alias("_first")))
    heads = known.filter("_first is not null").select(F.col("_run").alias("_to"), F.col("_first").alias("_nt"), F.col("_f").alias("_nf"))
    whole = Window.orderBy("_to")  # one row for each run, and the runs are bounded
    after = F.coalesce(F.lead("_to").over(whole), F.min("_to").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    links = heads.select("_to").select(F.col("_to").alias("_run"), after.alias("_to"))
    ends = known.filter("_last is not null").select("_k", "_f", "_run", F.col("_last").alias("_t")).join(links, "_run").join(heads, "_to")
    every = known.filter("_last is null").select(*done).unionByName(edit(ends).select(*done))
    return every.select(
        F.col("_k").alias(key), F.col("_n").alias("n_chars"), F.col("_es").alias("edited_sha256"), F.col("_f").alias("fingerprint"),
        F.col("_ef").alias("edited_fingerprint"), likeness(F.col("_f"), F.col("_ef")).alias("near_edited"), likeness(F.col("_f"), F.col("_nf")).alias("near_next"),
    )


def report_sql(source: str = "documents") -> str:
    """The same in DuckDB's SQL, over whole texts."""
    return f"""
with d as (select doc_id, coalesce(text, '') as t from {source}),
o as (select doc_id, t, row_number() over (order by doc_id desc nulls last, md5(t)) as r, count(*) over () as n from d),
e as (select o.*, x.r as nr, left(o.t, length(o.t) - length(o.t) // 2) || left(x.t, length(o.t) // 2) as et from o join o x on x.r = o.r % o.n + 1),
a as (select r, 0 as kind, t from e union all select r, 1, et from e),
w as (select r, kind, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from a),
h as (select r, kind, md5(array_to_string(list_slice(ws, i, i + {SHINGLE - 1}), ' ')) as h
  from (select r, kind, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, least(len(ws), 1)) + 1)) as i from w)),
m as (select r, kind, h[1:2] as b, right(min(h), 1) as digit from h group by all),
v as (select r, kind, (strpos('0123456789abcdef', b[1]) - 1) * 16 + strpos('0123456789abcdef', b[2]) - 1 as b, digit from m),
j as (select j, (j * 167) % 256 + 1 as a, (j * j * 91 + j * 57 + 29) % {PRIME} as c from range({BINS}) x(j)),
k as (select distinct r, kind from v),
z as (select k.r, k.kind, j.j, j.a, j.c, v.digit from k cross join j left join v on v.r = k.r and v.kind = k.kind and v.b = j.j),
y as (select z.r, z.kind, z.j, arg_min(v.digit, (v.b * z.a + z.c) % {PRIME}) as digit from z join v using (r, kind) where z.digit is null group by all),
f as (select r, kind, string_agg(digit, '' order by j) as f from
  (select r, kind, j, digit from z where digit is not null union all select r, kind, j, digit from y) group by all),
g as (select e.*, coalesce(p.f, repeat('-', {BINS})) as f, coalesce(q.f, repeat('-', {BINS})) as ef from e
  left join f p on p.r = e.r and p.kind = 0 left join f q on q.r = e.r and q.kind = 1),
s as (select g.*, x.f as nf from g join g x on x.r = g.nr)
select doc_id, length(t)::bigint as n_chars, sha256(et) as edited_sha256, f as fingerprint, ef as edited_fingerprint,
  greatest(0.0::double, (len(list_filter(range(1, {BINS + 1}), lambda i: f[i] = ef[i])) * {VALUES} - {BINS})::double / {BINS * (VALUES - 1)}.0::double) as near_edited,
  greatest(0.0::double, (len(list_filter(range(1, {BINS + 1}), lambda i: f[i] = nf[i])) * {VALUES} - {BINS})::double / {BINS * (VALUES - 1)}.0::double) as near_next
from s"""
