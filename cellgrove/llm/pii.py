"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is a Spark expression. Positions come from splitting a text by the
pattern that also gives the matches: lengths of pieces and matches add up to code
point offsets. Long arrays are worked on in blocks, so that time grows with the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import packed

#: Characters before a span in which context words count, and the score (in tenths) that keeps one.
REACH, KEEP = 40, 7
#: Matches in a block, and letters in a piece of a text that is put together anew.
BLOCK, PIECE = 256, 1024
CONFIRMED, NEARBY, CONTRARY = 4, 3, -3
BASE = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.translate(value, " -+().", "")


def _ip_ok(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."),
        lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) > 3, False).otherwise(
            F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255
        ),
    )


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    turned = F.reverse(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def _mod97(value: Column) -> Column:
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def carry(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(plain)), F.lit(0), carry) == 1


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``confirm`` must hold for what it proposes.

    ``sql_pattern`` and ``sql_confirm`` say the same to a linear-time matcher
    that knows neither look-behind nor possessive repeats. ``score`` is where the
    score starts, ``near`` and ``against`` are patterns of context words. Kinds
    of ``BASE`` stay whatever their score.
    """

    name: str
    pattern: str
    sql_pattern: str
    confirm: Callable[[Column], Column] | None
    sql_confirm: str
    score: int
    near: str
    against: str


# The shapes. Look-behinds and possessive repeats keep the search
# linear on long runs of one class; they find what the plain shapes find.
_EMAIL = "[A-Za-z0-9._%+-]"
_LUHN_SQL = (
    "length(regexp_replace(v, '[^0-9]', '', 'g')) between 14 and 19 and "
    "list_sum(list_transform(range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1), lambda i: "
    "(case when i % 2 = 1 then 1 else 2 end) * substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::int "
    "- case when i % 2 = 0 and substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), i, 1)::int > 4 then 9 else 0 end)) % 10 = 0"
)
_MOD97_SQL = (
    "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), "
    "lambda c: case when ascii(c) >= 65 then ascii(c) + 45 else ascii(c) - 48 end)), "
    "lambda a, d: case when d >= 100 then (a * 100 + d - 100) % 97 else (a * 10 + d) % 97 end) = 1"
)
# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:%s)" % "|".join(r"(?:%s)[0-9]{2}(?:\x20?[A-Z0-9]){%d}" % (c.replace(" ", "|"), n - 4) for n, c in IBAN_LENGTHS.items())
KINDS = (
    Kind(
        "email",
        rf"(?:(?<!{_EMAIL})|\G){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        rf"{_EMAIL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        None, "true", 8, "e-?mail|mail|contact", "example",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        _ip_ok,
        "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0",
        6, "ip|host|server|address", "version|release|section",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13,}", _luhn, _LUHN_SQL, 5, "card|visa|credit|payment", "isbn|order|serial"),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: F.length(_digits(v)).between(10, 15),
        "length(regexp_replace(v, '[^0-9]', '', 'g')) between 10 and 15",
        6, "phone|telephone|call|tel|mobile", "order|serial",
    ),
    Kind(
        "iban", rf"(?=[A-Z]{{2}}[0-9]{{2}}){_IBAN}", _IBAN,
        _mod97, _MOD97_SQL, 5, "iban|account|bank|konto", "serial|part",
    ),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", None, "true", 0, "ssn|social security", "order|serial"),
)
#: Starts added where there is no checksum to confirm: a shape alone is weak evidence, with context it is enough.
_UNPROVEN = {"ssn": 4}


def _start(kind: Kind) -> int:
    return kind.score + (CONFIRMED if kind.confirm in (_luhn, _mod97) else _UNPROVEN.get(kind.name, 0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` names it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(array: Column) -> Column:
    """The array in blocks of ``BLOCK``: what is built step by step stays short, so work grows with the array."""
    return F.when(F.size(array) == 0, F.array()).otherwise(
        _let(array, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda i: F.slice(a, i * BLOCK + 1, F.lit(BLOCK))))
    )


def _length(block: Column) -> Column:
    return F.aggregate(block, F.lit(0), lambda a, p: a + F.length(p["gap"]) + F.length(p["value"]))


def _offsets(lengths: Column) -> Column:
    """Sums of all lengths before each."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def _tail(blocks: Column, i: Column) -> Column:
    """The last ``REACH`` letters before a block, which the block before has: each match has some letters."""
    last = lambda b: F.right(F.array_join(F.transform(F.slice(b, F.greatest(F.size(b) - REACH + 1, F.lit(1)), F.lit(REACH)), lambda p: F.concat(p["gap"], p["value"])), ""), F.lit(REACH))
    return F.when(i > 0, last(F.get(blocks, i - 1))).otherwise("")


def _word(pattern: str) -> str:
    """Context words with borders, in plain letters so that all matchers agree; a plural ``s`` may follow."""
    return f"(?:^|[^a-z0-9])(?:{pattern})s?(?:$|[^a-z0-9])"


def _spans(text: Column, kind: Kind) -> Column:
    """Array of (start, rank, end, kind, score) for what is kept of one kind."""
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("value"))

    def place(block: Column, before: Column, tail: Column) -> Column:
        """Start, end, value and context of the matches of one block; ``tail`` is the text that ends before it."""

        def step(a: Column, p: Column) -> Column:
            context = F.right(F.concat(a["tail"], p["gap"]), F.lit(REACH))
            start = a["at"] + F.length(p["gap"])
            end = start + F.length(p["value"])
            one = F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), context.alias("context"))
            return F.struct(end.alias("at"), F.right(F.concat(context, p["value"]), F.lit(REACH)).alias("tail"), F.concat(a["found"], F.array(one)).alias("found"))

        none = F.array().cast("array<struct<start:int,end:int,value:string,context:string>>")
        return F.aggregate(block, F.struct(before.alias("at"), tail.alias("tail"), none.alias("found")), step, lambda a: a["found"])

    def blocks(parts: Column) -> Column:
        return _let(_blocks(parts), lambda bs: _let(_offsets(F.transform(bs, _length)), lambda at: F.flatten(F.transform(bs, lambda b, i: place(b, F.get(at, i), _tail(bs, i))))))

    placed = _let(F.filter(found, lambda p: p["value"].isNotNull()), blocks)
    if kind.confirm is not None:
        placed = F.filter(placed, lambda s: kind.confirm(s["value"]))

    def scored(s: Column) -> Column:
        before = F.lower(s["context"])
        score = _start(kind) + F.when(before.rlike(_word(kind.near)), NEARBY).otherwise(0) + F.when(before.rlike(_word(kind.against)), CONTRARY).otherwise(0)
        return F.struct(
            s["start"].alias("start"), F.lit([k.name for k in KINDS].index(kind.name)).alias("rank"), s["end"].alias("end"),
            F.lit(kind.name).alias("kind"), score.cast("int").alias("score"),
        )

    found = F.transform(placed, scored)
    if kind.name not in BASE:
        found = F.filter(found, lambda s: s["score"] >= KEEP)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:int>>")
    return F.when(text.rlike(kind.pattern), found).otherwise(none)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` (the whole input row), ``_text`` and ``_spans`` sorted by start, then kind in table order.

    A null text counts as an empty one and has no spans. Spans of different
    kinds may overlap; those of one kind do not.
    """
    step = docs.select(packed(docs), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    step = step.select("_row", "_text", *[_spans(F.col("_text"), k).alias(f"_{k.name}") for k in KINDS])
    return step.select("_row", "_text", F.sort_array(F.concat(*[f"_{k.name}" for k in KINDS])).alias("_spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind and the spans of every row; only ``key`` and ``text`` are read."""
    found = find(docs.select(key, text), text)
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    of = lambda name: F.size(F.filter("_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        F.col("_row")[key].alias(key), *[of(k.name) for k in KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"),
        F.transform("_spans", lambda s: s["score"]).alias("scores"),
    )


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All columns as they are, but each maximal run of spans replaced by ``<KIND>`` of its first.

    ``n_chars``, where the table has it, follows the new text; null texts stay null.
    """
    found = find(docs, text)
    # letters a to z (from 0) of the text, from pieces, so that a late place costs no more than an early one
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)

    def cut(ps: Column, a: Column, z: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((z - 1) / PIECE).cast("int")
        return F.when(z > a, F.substring(F.array_join(F.slice(ps, first + 1, last - first + 1), ""), a % PIECE + 1, z - a)).otherwise("")

    def clean(ps: Column, block: Column, before: Column) -> Column:
        """Texts and tags of one block of spans; ``before`` is the end of all spans ahead of it."""

        def step(a: Column, s: Column) -> Column:
            new = F.concat(cut(ps, a["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            out = F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(new))).otherwise(a["out"])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

        start = F.struct(before.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(block, start, step, lambda a: F.array_join(a["out"], ""))

    def assemble(ps: Column, bs: Column) -> Column:
        ends = F.transform(bs, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        upto = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))
        parts = lambda at: F.concat(
            F.array_join(F.transform(bs, lambda b, i: clean(ps, b, F.get(at, i))), ""), cut(ps, F.element_at(at, -1), F.length("_text"))
        )
        return _let(upto, parts)

    cleaned = _let(pieces, lambda ps: _let(_blocks(F.col("_spans")), lambda bs: assemble(ps, bs)))
    had = F.size("_spans") > 0
    out = found.select("_row", F.when(had, cleaned).alias("_new"))
    cols = []
    for c in docs.columns:
        old = F.col("_row")[c]
        if c == text:
            cols.append(F.coalesce("_new", old).alias(c))
        elif c == n_chars:
            cols.append(F.coalesce(F.length("_new").cast(docs.schema[c].dataType), old).alias(c))
        else:
            cols.append(old.alias(c))
    return out.select(*cols)


def spans_sql(source: str = "documents") -> str:
    """DuckDB's SQL for the rows of ``report``, without scores."""
    steps, names = [], []
    for n, k in enumerate(KINDS):
        rule = k.sql_confirm
        score = (
            f"{_start(k)} + case when regexp_matches(c, '{_word(k.near)}') then {NEARBY} else 0 end"
            f" + case when regexp_matches(c, '{_word(k.against)}') then {CONTRARY} else 0 end"
        )
        stay = "" if k.name in BASE else f" and {score} >= {KEEP}"
        steps.append(
            f"r{n} as (select rid, t, m, i, "
            "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint as s "
            f"from (select rid, t, regexp_extract_all(t, '{k.sql_pattern}') as m, string_split_regex(t, '{k.sql_pattern}') as p, "
            f"unnest(range(1, len(regexp_extract_all(t, '{k.sql_pattern}')) + 1)) as i from t)),\n"
            f"k{n} as (select rid, {n} as rank, '{k.name}' as kind, s, s + length(v) as e from "
            f"(select rid, s, m[i] as v, lower(substr(t, greatest(s - {REACH}, 0) + 1, s - greatest(s - {REACH}, 0))) as c from r{n}) where {rule}{stay})"
        )
        names.append(f"select * from k{n}")
    counts = ", ".join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in KINDS)
    zero = ", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in KINDS)
    base = ", ".join(f"'{b}'" for b in BASE)
    one = "kind || ':' || s || ':' || e"
    return (
        f"with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from {source}),\n" + ",\n".join(steps)
        + f",\nk as ({' union all '.join(names)}),\n"
        f"a as (select rid, {counts}, string_agg({one}, ',' order by s, rank) as spans, "
        f"string_agg({one}, ',' order by s, rank) filter (kind in ({base})) as base from k group by rid)\n"
        f"select doc_id, {zero}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join a using (rid)"
    )
