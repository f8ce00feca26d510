"""Quality rules: a threshold table compiled into projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import packed, words

WINDOW = 5
#: Words from which a lack of stop words tells something, and the languages whose stop words are listed.
STOP_BASE, STOP_LANGS = 50, ("en", "fr", "de", "es")

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it was with as on be this are by from at a "
    "le la les de des un une et est que en dans au ce il pas par pour "
    "der die das und ist ein eine zu den mit von nicht auf im "
    "el los las del y que se por con una su para lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= per * numerator / denominator <= high``, in whole numbers.

    A rule whose denominator is zero holds.
    """

    name: str
    numerator: str
    denominator: str
    per: int
    low: int | None
    high: int | None

    def holds(self) -> Column:
        top = F.col(self.numerator) * F.lit(self.per).cast("long")
        below = F.col(self.denominator)
        parts = [F.lit(True)]
        if self.low is not None:
            parts.append(top >= below * self.low)
        if self.high is not None:
            parts.append(top <= below * self.high)
        return (below == 0) | reduce(Column.__and__, parts)

    def sql(self) -> str:
        parts = [] if self.low is None else [f"{self.numerator} * {self.per} >= {self.denominator} * {self.low}"]
        parts += [] if self.high is None else [f"{self.numerator} * {self.per} <= {self.denominator} * {self.high}"]
        return f"({self.denominator} = 0 or ({' and '.join(parts)}))"


#: The base: a text that breaks one of these fails whatever the other rules say.
BASE_RULES = (
    Rule("length", "n_words", "one", 1, 10, None),
    Rule("repeated_words", "n_repeat_words", "n_words", 100, None, 20),
)
#: The threshold table. Change it by passing another one.
RULES = (
    Rule("word_length", "word_chars", "n_words", 10, 15, 200),
    Rule("symbols", "n_symbols", "n_words", 100, None, 20),
    Rule("stop_words", "n_stop_words", "n_stop_base", 1000, 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, None, 40),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_stop_base")


def measure(docs: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """``_row`` (the whole input row) with the measures of ``text``, in one stage.

    n_words, word_chars (code points in words), n_symbols (``#*$%&|<>``),
    n_lines (\\n-split lines with a word), n_dup_lines (of those, equal to an
    earlier one), n_repeat_words (words inside 5-word windows that occur at
    least twice, first ones included), n_stop_words, n_stop_base (n_words where
    stop words are to be expected: from ``STOP_BASE`` words on and, if ``lang`` is
    given, in ``STOP_LANGS``; else zero). A null text counts as an empty one: all
    zero. Repeated rows are measured each for themselves.

    Windows are compared as strings. Only texts with fewer distinct windows than
    windows pay for the sort that finds where the repeated ones are.
    """
    col = F.coalesce(F.col(text), F.lit(""))
    known = F.lit(True) if lang is None else F.coalesce(F.col(lang).isin(*STOP_LANGS), F.lit(False))
    step = docs.select(packed(docs), col.alias("_t"), words(F.col(text)).alias("_w"), known.alias("_known"))
    step = step.select(
        "_row",
        "_w",
        F.when(F.col("_known") & (F.size("_w") >= STOP_BASE), F.size("_w")).otherwise(0).cast("long").alias("n_stop_base"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(
            F.size("_w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.concat_ws(" ", F.slice("_w", i, WINDOW))),
        ).alias("_g"),
    )
    step = step.select(
        "_row",
        *MEASURES[:3],
        "n_stop_base",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("_s"),
    )
    again = F.filter(
        F.transform(
            "_s",
            lambda s, j: F.when(
                (s["g"] == F.get(F.col("_s"), j - 1)["g"]) | (s["g"] == F.get(F.col("_s"), j + 1)["g"]), s["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    step = step.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(again)))
    gaps = F.transform("_p", lambda p, j: F.coalesce(F.least(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    return step.select("_row", *[m for m in MEASURES if m != "n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and failed (names of the broken rules, in table order)."""
    one = measured.withColumn("one", F.lit(1).cast("long"))
    broken = lambda table: F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in table]), lambda x: x.isNotNull())
    base, more = broken(BASE_RULES), broken(rules)
    return one.select(
        *measured.columns,
        (F.size(base) > 0).alias("base_failed"),
        (F.size(F.concat(base, more)) == 0).alias("kept"),
        F.concat(base, more).alias("failed"),
    )


def quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = "lang"
) -> DataFrame:
    """One row per input row: key, measures, base_failed, kept, failed.

    Only ``key``, ``text`` and ``lang`` (None: not known) are read; a null key
    stays null. An empty table gives an empty result.
    """
    judged = judge(measure(docs.select(key, text, *([] if lang is None else [lang])), text, lang), rules)
    return judged.select(F.col("_row")[key].alias(key), *[c for c in judged.columns if c != "_row"])


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = "lang") -> DataFrame:
    """The rows that pass, with all their columns unchanged."""
    # the row number keeps the filter above the projections, which would be repeated inside it
    judged = judge(measure(docs, text, lang), rules).withColumn("_n", F.monotonically_increasing_id())
    return judged.filter("kept and _n >= 0").select("_row.*")


def quality_sql(rules: tuple[Rule, ...] = RULES, source: str = "documents", where: str = "true") -> str:
    """The same in DuckDB's SQL, over whole texts."""
    stop, langs = (", ".join(f"'{w}'" for w in ws) for ws in (STOP_WORDS, STOP_LANGS))
    base = " and ".join(r.sql() for r in BASE_RULES)
    more = " and ".join(r.sql() for r in rules)
    names = ", ".join(f"case when not {r.sql()} then '{r.name}' end" for r in (*BASE_RULES, *rules))
    return f"""
with t as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from {source} where {where}),
w as (select rid, doc_id, lang, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select rid, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' '))) as g,
  unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW}),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1),
c as (select rid, sum(least({WINDOW}, nxt - i)) as n from
  (select rid, i, coalesce(lead(i) over (partition by rid order by i), i + {WINDOW}) as nxt from r) group by rid),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint as n_stop_words, coalesce(c.n, 0)::bigint as n_repeat_words, 1 as one,
  case when len(ws) >= {STOP_BASE} and lang in ({langs}) then len(ws) else 0 end::bigint as n_stop_base
  from w left join c using (rid))
select doc_id, {", ".join(MEASURES)}, not ({base}) as base_failed, ({base}) and {more} as kept,
  array_to_string(list_filter([{names}], lambda x: x is not null), ',') as failed from m"""
