"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The tree is domain, language, source. A node's budget goes to its children in
proportion to their weights, but no child gets more than its whole subtree can
give in ``epochs`` passes; what it can't take goes to its siblings first. As
capacities are those of subtrees, an ancestor is only short, and passes its
shortage to its own siblings, when all below it is used up.

A leaf with a budget of b tokens and t tokens in all gives b div t whole epochs and
then the first b mod t tokens of one more, whose order is seeded by its number.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.llm.common import packed
from cellgrove.session import cut

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that make one level of buckets.
DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers, by name at each level, ``other`` for names not listed.

    ``share`` is the budget in thousandths of the tokens there are; ``budget``,
    if given, is the budget in tokens instead.
    """

    domain: dict[str, int] = field(default_factory=lambda: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    share: int = 900
    budget: int | None = None
    epochs: int = 2
    seed: int = 42

    def weight(self, level: str) -> Column:
        table = getattr(self, level)
        return reduce(lambda e, kv: e.when(F.col(level) == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0)).otherwise(self.other).cast("long")

    def weight_sql(self, level: str) -> str:
        cases = " ".join(f"when {level} = '{k}' then {v}" for k, v in getattr(self, level).items())
        return f"(case {cases} else {self.other} end)::bigint" if cases else f"{self.other}::bigint"


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo four, ``domain_other`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "domain_other").otherwise(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")))


def _fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Adds ``got``: the parent's ``budget`` over its children by ``w``, none above ``cap``.

    Ordered by cap / w the children that are filled up are a prefix; a child
    belongs to it if its part of what is left is no less than its capacity.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(F.col("cap") / F.col("w")), *[c for c in LEVELS if c in nodes.columns])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = nodes.withColumns(
        {"left_over": (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))), "weights": F.sum("w").over(after)}
    )
    step = step.withColumn("full", big("cap") * big("weights") <= big("left_over") * big("w"))
    step = step.withColumns(
        {
            "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0)),
            "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings), F.lit(0)),
        }
    )
    part = F.when(F.col("open") == 0, F.lit(0).cast("long")).otherwise(F.expr("cast(w as decimal(18,0)) * cast(rest as decimal(18,0)) div greatest(open, 1)"))
    return step.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("left_over", "weights", "full", "rest", "open")


def budgets(leaves: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per leaf (domain, lang, source, tokens): ``budget``, whole ``epochs`` and the ``rest`` of the next one.

    A node of weight zero gives nothing. Quotients are cut to whole tokens, so
    each node may leave less than one token a child unused. Null names are nodes
    of their own. Where all is used up the total falls short of the budget.
    """
    leaf = leaves.select(*LEVELS, "tokens", mix.weight("source").alias("w"))
    leaf = leaf.withColumn("cap", F.when(F.col("w") > 0, F.col("tokens") * mix.epochs).otherwise(0))
    langs = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    langs = langs.withColumn("w", mix.weight("lang")).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("w", mix.weight("domain")).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
    total = F.lit(mix.budget).cast("long") if mix.budget is not None else F.expr(f"cast(sum(tokens) over (partition by 0) as decimal(20,0)) * {mix.share} div 1000")

    def handed(nodes: DataFrame, given: DataFrame, on: list[str]) -> DataFrame:
        given = given.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("got").alias("budget"))
        match = reduce(Column.__and__, [nodes[c].eqNullSafe(given[f"_{c}"]) for c in on])
        return nodes.join(given, match).drop(*[f"_{c}" for c in on])

    top = _fill(domains.withColumn("budget", total), [])
    mid = _fill(handed(langs, top, ["domain"]), ["domain"])
    low = _fill(handed(leaf, mid, ["domain", "lang"]), ["domain", "lang"])
    rounds = F.when(F.col("tokens") > 0, F.expr("got div greatest(tokens, 1)")).otherwise(0).cast("long")
    return low.select(*LEVELS, "tokens", F.col("got").alias("budget"), rounds.alias("epochs"), (F.col("got") - rounds * F.col("tokens")).alias("rest"))


def _on_leaf(a: DataFrame, b: DataFrame) -> Column:
    return reduce(Column.__and__, [a[c].eqNullSafe(b[f"_{c}"]) for c in LEVELS])


def _boundary(rows: DataFrame, digit: Column, base: str) -> DataFrame:
    """Per leaf, the bucket in which the running sum passes ``rest``, and the sum before it."""
    sums = rows.groupBy(*LEVELS, "rest", base, digit.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col(base) + F.coalesce(F.sum("n").over(running), F.lit(0)))
    hit = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))
    return sums.filter(hit).select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "bucket", "before")


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``_row`` (the whole input row), its leaf, ``n_tokens``, ``copies`` and ``tokens_taken``.

    copies counts the epochs in which the row is taken, the last one in part if
    the budget ends inside it; tokens_taken adds up to the leaf's budget. Rows
    that give nothing have copies 0 and stay. A token is a word
    ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none. Ties of the seeded
    order (repeated keys) are ordered by length and text.

    The running sum is never formed over a whole leaf. Sums over 4,096 buckets of
    the order key show the bucket in which the budget ends, then those of its
    4,096 parts; only the rows of that part are sorted.
    """
    rows = docs.select(
        packed(docs), F.col(key).cast("string").alias("_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text"),
        domain_of(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("long").alias("n_tokens"),
    )
    slim = cut(rows.select("_id", *LEVELS, "n_tokens"))
    given = cut(budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mix)).select(
        *[F.col(c).alias(f"_{c}") for c in LEVELS], "epochs", "rest"
    )

    def ordered(table: DataFrame) -> DataFrame:
        key_of = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.coalesce("_id", F.lit(""))).cast("binary"))
        return table.join(given, _on_leaf(table, given)).drop(*[f"_{c}" for c in LEVELS]).withColumn("_order", key_of)

    first, second = F.substring("_order", 1, DIGITS), F.substring("_order", 1 + DIGITS, DIGITS)
    inside = ordered(slim).withColumn("zero", F.lit(0).cast("long"))
    edge = cut(_boundary(inside, first, "zero"))
    inside = inside.drop("zero").join(edge, _on_leaf(inside, edge) & (first == F.col("bucket"))).drop(*[f"_{c}" for c in LEVELS], "bucket")
    fine = _boundary(inside, second, "before").select(*[f"_{c}" for c in LEVELS], F.col("bucket").alias("part"), F.col("before").alias("at"))
    ends = edge.join(
        fine.select(*[F.col(f"_{c}").alias(f"f_{c}") for c in LEVELS], "part", "at"),
        reduce(Column.__and__, [F.col(f"_{c}").eqNullSafe(F.col(f"f_{c}")) for c in LEVELS]),
    ).select(*[f"_{c}" for c in LEVELS], F.concat("bucket", "part").alias("end"), "at")
    ends = cut(ends)

    every = ordered(rows)
    every = every.join(ends, _on_leaf(every, ends), "left").drop(*[f"_{c}" for c in LEVELS])
    place = F.substring("_order", 1, 2 * DIGITS)
    take = lambda start: F.greatest(F.least(F.col("rest") - start, F.col("n_tokens")), F.lit(0))

    def given_out(table: DataFrame, part: Column, more: Column) -> DataFrame:
        return table.select(
            "_row", *LEVELS, "n_tokens", (F.col("epochs") + more.cast("long")).alias("copies"),
            (F.col("epochs") * F.col("n_tokens") + part).cast("long").alias("tokens_taken"),
        )

    at_end = F.coalesce(place == F.col("end"), F.lit(False))
    clear = every.filter(~at_end)
    wholly = F.coalesce(place < F.col("end"), F.lit(False))
    sure = given_out(clear, F.when(wholly, F.col("n_tokens")).otherwise(0), wholly)
    run = Window.partitionBy(*LEVELS).orderBy("_order", "n_tokens", "_text").rowsBetween(Window.unboundedPreceding, -1)
    last = every.filter(at_end).withColumn("start", F.col("at") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    return sure.unionByName(given_out(last, take(F.col("start")), F.col("start") < F.col("rest")))


def report(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Key, leaf, n_tokens, copies and tokens_taken of every row."""
    only = docs.select(*dict.fromkeys([key, text, lang, source]))
    return mixed(only, mix, key, text, lang, source).select(F.col("_row")[key].alias(key), *LEVELS, "n_tokens", "copies", "tokens_taken")


def select_mix(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that are taken, once for each copy and in whole, with their columns unchanged."""
    taken = mixed(docs, mix, key, text, lang, source).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def report_sql(mix: Mix = Mix(), source: str = "documents") -> str:
    """DuckDB's SQL for ``report``, with plain running sums over whole leaves."""

    def fill(name: str, nodes: str, parents: str, tie: str) -> str:
        by = f"partition by {parents}" if parents else ""
        return (
            f"{name}a as (select *, budget - coalesce(sum(cap) over ({by} order by ratio, {tie} rows between unbounded preceding and 1 preceding), 0) as lo, "
            f"sum(w) over ({by} order by ratio, {tie} rows between current row and unbounded following) as ws from "
            f"(select *, case when w = 0 then 'inf'::double else cap::double / w end as ratio from {nodes})),\n"
            f"{name}b as (select *, cap::hugeint * ws::hugeint <= lo::hugeint * w::hugeint as isfull from {name}a),\n"
            f"{name}c as (select *, budget - coalesce(sum(cap) filter (isfull) over ({by}), 0) as rem, coalesce(sum(w) filter (not isfull) over ({by}), 0) as opened from {name}b),\n"
            f"{name} as (select * exclude (budget), case when isfull then cap when opened = 0 then 0 else (w::hugeint * rem::hugeint) // opened::hugeint end::bigint as got from {name}c)"
        )

    total = f"{mix.budget}::bigint" if mix.budget is not None else f"((sum(tokens) over ())::hugeint * {mix.share} // 1000)::bigint"
    n = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return f"""
with d as (select doc_id, case when {n} = '' then 'domain_other' else 'domain' || ({n}::bigint % 4) end as domain, lang, source, coalesce(text, '') as t,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from {source}),
leaf as (select *, case when w > 0 then tokens * {mix.epochs} else 0 end as cap from
  (select domain, lang, source, sum(n_tokens)::bigint as tokens, any_value({mix.weight_sql("source")}) as w from d group by all)),
langs as (select domain, lang, w, tokens, case when w > 0 then cap else 0 end as cap from
  (select domain, lang, {mix.weight_sql("lang")} as w, sum(tokens)::bigint as tokens, sum(cap)::bigint as cap from leaf group by domain, lang)),
doms as (select domain, w, tokens, case when w > 0 then cap else 0 end as cap, {total} as budget from
  (select domain, {mix.weight_sql("domain")} as w, sum(tokens)::bigint as tokens, sum(cap)::bigint as cap from langs group by domain)),
{fill("top", "doms", "", "domain")},
mid0 as (select langs.*, got as budget from langs join top on langs.domain is not distinct from top.domain),
{fill("mid", "mid0", "domain", "lang")},
low0 as (select leaf.*, got as budget from leaf join mid on leaf.domain is not distinct from mid.domain and leaf.lang is not distinct from mid.lang),
{fill("low", "low0", "domain, lang", "source")},
e as (select domain, lang, source, case when tokens > 0 then got // tokens else 0 end as epochs, got - case when tokens > 0 then got // tokens else 0 end * tokens as rest from low),
o as (select d.*, e.epochs, e.rest, coalesce(sum(n_tokens) over (partition by d.domain, d.lang, d.source
  order by md5('{mix.seed}:' || epochs || ':' || coalesce(doc_id::varchar, '')), n_tokens, md5(t) rows between unbounded preceding and 1 preceding), 0) as start
  from d join e on d.domain is not distinct from e.domain and d.lang is not distinct from e.lang and d.source is not distinct from e.source)
select doc_id, domain, lang, source, n_tokens, (epochs + (start < rest)::int)::bigint as copies,
  (epochs * n_tokens + greatest(least(rest - start, n_tokens), 0))::bigint as tokens_taken from o"""
