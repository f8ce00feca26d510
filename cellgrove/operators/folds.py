"""Folds, splits and samples. Orders come from hashes of the row id, so they are
reproducible, and ranks inside a class never gather the class in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.operators.ranking import bucketed_row_number, hash_key, hash_row_number
from cellgrove.session import cut

#: Groups, or bundles of groups, that one task deals at a time.
DEAL_AT_ONCE = 2_000


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Deal each class round-robin in hash order; class counts per fold differ by at most one."""
    ranked = hash_row_number(df, [label], id_col, seed, "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")


def stratified_group_kfold(df: DataFrame, label: str, group: str, k: int, seed: int) -> DataFrame:
    """No group in two folds, classes balanced by a snake deal of groups.

    Groups are summarised first, so a group holding much of the table is one
    row here. They are dealt per dominant class, largest first, back and forth
    over the folds.
    """
    counts = df.groupBy(F.col(group).alias("_g"), F.col(label).alias("_l")).agg(F.count("*").alias("_c"))
    groups = counts.groupBy("_g").agg(
        F.sum("_c").alias("_size"), F.max_by("_l", F.struct("_c", "_l")).alias("_dom")
    )
    digest = hash_key("_g", seed)
    # sizes up to 64 are exact buckets and split further by hash; larger ones by power of two
    exact = F.col("_size") <= 64
    size_class = F.when(exact, F.col("_size")).otherwise(64 + F.floor(F.log2(F.col("_size"))))
    ranked = bucketed_row_number(
        groups,
        ["_dom"],
        [(size_class, False), (F.when(exact, F.substring(digest, 1, 3)).otherwise(""), True)],
        [F.col("_size").desc(), digest],
        "_rn",
    )
    turn = (F.col("_rn") - 1) % (2 * k)
    dealt = ranked.select(
        "_g", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold")
    )
    return df.join(dealt, df[group].eqNullSafe(dealt["_g"])).drop("_g")


def _deal(items: pd.DataFrame, k: int, held: list[tuple], rest: dict[str, int], turn: int) -> np.ndarray:
    """A fold for each item: heaviest first, each to the fold that holds least of the classes it brings.

    ``v`` holds (class, count) pairs; counts are taken as shares of their class, so
    that small classes weigh as much as large ones. ``held`` says what the folds
    hold already, as (fold, class, count); of that a piece makes up for as much as
    it has of the ``rest`` of the class. ``turn`` says which fold comes first in ties.
    """
    classes = {c: i for i, c in enumerate(sorted({e["c"] for v in items["v"] for e in v}))}
    counts = np.zeros((len(items), len(classes)))
    for i, v in enumerate(items["v"]):
        for e in v:
            counts[i, classes[e["c"]]] = e["n"]
    total, start = counts.sum(0), np.zeros((k, len(classes)))
    for f, c, n in held:
        if c in classes:
            start[f, classes[c]] = n * total[classes[c]] / rest[c]
    scale = total + start.sum(0)
    shares, folds = counts / scale, start / scale
    order, chosen = (np.arange(k) - turn) % k, np.zeros(len(items), np.int32)
    for i in np.argsort(-shares.sum(1), kind="stable"):
        chosen[i] = np.lexsort((order, np.round(folds.sum(1), 9), np.round(folds @ shares[i], 9)))[0]
        folds[chosen[i]] += shares[i]
    return chosen


def group_kfold_by_vectors(
    df: DataFrame, label: str, group: str, k: int, seed: int, at_once: int = DEAL_AT_ONCE
) -> DataFrame:
    """No group in two folds, every class spread evenly, by the groups' whole class vectors.

    The ``at_once`` largest groups are dealt first, in one task (``_deal``). The
    others follow in pieces of about that size, by the rarest class they hold, so
    that a rare class isn't scattered over pieces; each piece makes up for its
    share of what the large groups left uneven. Folds differ by about a group a
    piece at most, so small pieces balance less well. Rows with a null group are one
    group, a null label is a class of its own. Classes are taken to be few: one
    count for each class and fold passes through the driver.
    """
    named = df.select(F.col(group).alias("_g"), F.to_json(F.struct(F.col(label).alias("l"))).alias("c"))
    counts = named.groupBy("_g", "c").agg(F.count("*").alias("n"))
    totals = counts.groupBy("c").agg(F.sum("n").alias("t"))
    vectors = counts.join(totals, "c").groupBy("_g").agg(
        F.sort_array(F.collect_list(F.struct("c", "n"))).alias("v"),
        F.sum("n").alias("size"),
        F.min_by("c", F.struct("t", "c")).alias("rare"),
    )
    groups = cut(vectors.withColumn("_id", hash_key(F.to_json(F.struct("_g")), seed)))

    def dealer(held: list[tuple], rest: dict[str, int]):
        def run(piece: pd.DataFrame) -> pd.DataFrame:
            piece = piece.sort_values("_id")
            turn = int(piece["_id"].iloc[0][:8], 16) % k
            return pd.DataFrame({"_id": piece["_id"], "fold": _deal(piece, k, held, rest, turn)})

        return run

    large = groups.orderBy(F.desc("size"), "_id").limit(at_once)
    first = cut(large.withColumn("_p", F.lit("")).groupBy("_p").applyInPandas(dealer([], {}), "_id string, fold int"))
    left = groups.join(first, "_id", "left_anti")
    parts = left.groupBy("rare").agg(F.ceil(F.count("*") / at_once).alias("_parts"))
    tagged = left.join(parts, "rare").withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    by_class = F.sum("n").alias("n")
    held = first.join(groups, "_id").select("fold", F.inline("v")).groupBy("fold", "c").agg(by_class).collect()
    rest = {r.c: r.n for r in left.select(F.inline("v")).groupBy("c").agg(by_class).collect()}
    run = dealer([(r.fold, r.c, r.n) for r in held], rest)
    others = tagged.groupBy("rare", "_p").applyInPandas(run, "_id string, fold int")
    folds = groups.select("_g", "_id").join(first.unionByName(others), "_id").select("_g", "fold")
    return df.join(folds, df[group].eqNullSafe(folds["_g"])).drop("_g")


def fold_crosstab(df: DataFrame, fold: str, label: str, classes: list) -> DataFrame:
    """Rows per fold and class, one column per declared class, zeros kept."""
    return df.groupBy(fold).agg(
        *[F.count_if(F.col(label) == c).alias(str(c)) for c in classes]
    )


def leak_report(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that occur in more than one fold."""
    return (
        df.groupBy(group)
        .agg(F.count_distinct(fold).alias("n_folds"), F.count("*").alias("n_rows"))
        .filter(F.col("n_folds") > 1)
    )


def _with_group_size(df: DataFrame, by: list[str]) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    return df.join(sizes, by)


def stratified_split(df: DataFrame, by: list[str], id_col: str, frac: float, seed: int) -> DataFrame:
    """``split`` is test for the first bround(n * frac) rows of each source, else train."""
    ranked = _with_group_size(hash_row_number(df, by, id_col, seed, "_rn"), by)
    test = F.col("_rn") <= F.bround(F.col("_n") * F.lit(frac), 0)
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_rn", "_n")


def ratio_split(
    df: DataFrame, by: list[str], id_col: str, ratio: tuple[int, ...] = (8, 1, 1), seed: int = 42
) -> DataFrame:
    """Train, valid and test by cumulative cut points inside each class."""
    ranked = _with_group_size(hash_row_number(df, by, id_col, seed, "_rn"), by)
    total = sum(ratio)
    edge = lambda part: F.bround(F.col("_n") * F.lit(part / total), 0)
    split = (
        F.when(F.col("_rn") <= edge(ratio[0]), "train")
        .when(F.col("_rn") <= edge(ratio[0] + ratio[1]), "valid")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_rn", "_n")


def class_counts(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Count per declared class, in declared order, zeros kept."""
    found = df.filter(F.col(label).isin(*classes)).groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n"))
    declared = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("position", "cls")
    )
    return declared.join(found, "cls", "left").select(
        "position", "cls", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def class_weights(
    df: DataFrame, label: str, classes: list, mode: str = "balanced", cap: float = 4.0
) -> DataFrame:
    """Inverse-frequency class weights, plain or tapered, capped and scaled to mean 1."""
    counts = class_counts(df, label, classes)
    everything = Window.partitionBy(F.lit(0))  # one row per declared class
    inverse = F.sum("n").over(everything) / (F.lit(len(classes)) * F.greatest("n", F.lit(1)))
    if mode == "balanced":
        return counts.select("cls", "n", inverse.alias("weight"))
    if mode == "capped":
        tapered = counts.withColumn("_w", F.least(F.sqrt(inverse), F.lit(float(cap))))
        return tapered.select("cls", "n", (F.col("_w") / F.avg("_w").over(everything)).alias("weight"))
    raise ValueError(mode)


def head_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group; Spark limits each group before the shuffle."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rn") <= n)


def sample_per_class(
    df: DataFrame,
    label: str,
    id_col: str,
    n: int,
    seed: int,
    wanted: list | None = None,
    fallback: dict | None = None,
) -> DataFrame:
    """n seeded rows per class; an absent class takes those of its fallback, then any rows."""
    key = hash_key(id_col, seed)
    own = head_per_group(df, [label], [key, F.col(id_col)], n)
    if wanted is None:
        return own.withColumn("wanted", F.col(label))
    fallback = fallback or {}
    anyone = df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
    order = Window.partitionBy(F.lit(0)).orderBy(key, F.col(id_col))
    offers = [
        own.filter(F.col(label).isin(*wanted)).withColumns({"wanted": F.col(label), "_p": F.lit(0)}),
        anyone.withColumn("rn", F.row_number().over(order))
        .withColumn("wanted", F.explode(F.array(*[F.lit(c) for c in wanted])))
        .withColumn("_p", F.lit(2)),
    ]
    for target, source in fallback.items():
        offers.append(own.filter(F.col(label) == source).withColumns({"wanted": F.lit(target), "_p": F.lit(1)}))
    pool = offers[0]
    for o in offers[1:]:
        pool = pool.unionByName(o)
    # at most 3 n rows per wanted class are left here
    best = F.min("_p").over(Window.partitionBy("wanted"))
    return pool.withColumn("_best", best).filter("_p = _best").drop("_p", "_best")


def round_robin(df: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """Take classes in turn until ``limit`` rows."""
    return head_per_group(df, [by], order, limit).orderBy("rn", by).limit(limit)


def weighted_sample(
    df: DataFrame, id_col: str, weight: Column, seed: int, n: int | None = None
) -> DataFrame:
    """n draws with replacement, each row with probability proportional to its weight.

    Weights become whole numbers, a million on average, so interval ends are
    exact whatever the weights' scale; any positive weight is one unit at least, so
    very light rows can be drawn. Rows own intervals
    of the running total; draws are uniform points. Both are sent to equal slots
    of the line and matched by one sorted pass per slot, so neither a heavy row
    nor a heavy class lands in one task.
    """
    spark = df.sparkSession
    mean = df.agg(F.avg(weight).alias("mean"), F.count("*").alias("rows")).first()
    unit = 1_000_000.0 / mean["mean"]
    weighed = df.filter(weight > 0).select(id_col, F.greatest(F.round(weight * unit).cast("long"), F.lit(1)).alias("_w"))
    row = weighed.agg(F.sum("_w").alias("total")).first()
    draws_n = n if n is not None else mean["rows"]
    slots = max(1, draws_n // 100_000)
    width = -(-row["total"] // slots)
    key = hash_key(id_col, seed)
    lines = bucketed_row_number(
        weighed, [], [(F.substring(key, 1, 3), True)], [key, F.col(id_col)], "_rn", F.col("_w"), "_end"
    ).select(id_col, (F.col("_end") - F.col("_w")).cast("long").alias("_lo"), F.col("_end").cast("long").alias("_hi"))
    owners = lines.select(
        F.explode(
            F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))
        ).alias("_slot"),
        F.greatest("_lo", F.col("_slot") * width).alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("draw"),
        F.col(id_col),
    )
    points = spark.range(draws_n).select(
        F.col("id").alias("draw"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(row["total"])).alias("_at"),
    ).select(
        F.floor(F.col("_at") / width).alias("_slot"),
        "_at",
        F.lit(1).alias("_kind"),
        "draw",
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
    )
    sweep = Window.partitionBy("_slot").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        owners.unionByName(points)
        .withColumn("_owner", F.last(id_col, ignorenulls=True).over(sweep))
        .filter("_kind = 1")
        .select("draw", F.col("_owner").alias(id_col))
    )


def filter_classes(df: DataFrame, label: str, keep: list, remap: dict | None = None, out: str = "label_id") -> DataFrame:
    """Keep listed classes and give them new ids."""
    kept = df.filter(F.col(label).isin(*keep))
    ids = remap or {c: i for i, c in enumerate(keep)}
    lookup = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return kept.withColumn(out, lookup[F.col(label)])


def encode_label(df: DataFrame, label: str, classes: list[str], out: str = "label_id") -> DataFrame:
    """Class name to its position; unknown names become NULL."""
    lookup = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    return df.withColumn(out, F.try_element_at(lookup, F.col(label)))


def decode_label(df: DataFrame, label_id: str, classes: list[str], out: str = "label") -> DataFrame:
    return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in classes]), F.col(label_id)))
