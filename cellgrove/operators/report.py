"""Multi-class reports over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.functions.logits import argmax, expected_rank, let, soft_cross_entropy


def pair_counts(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Counts per (group, truth, prediction): the only shuffle of every report."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _class_rows(classes: list) -> Column:
    return F.explode(F.array(*[F.lit(c) for c in classes]))


def per_class(pairs: DataFrame, classes: list, by: list[str] = ()) -> DataFrame:
    """tp, support and predicted per declared class, zeros included."""
    by = list(by)
    sides = F.array(
        F.struct(
            F.col("y").alias("cls"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col("pred").alias("cls"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("long").alias("tp"),
        ),
        *[
            F.struct(
                F.lit(c).alias("cls"),
                F.lit(0).cast("long").alias("support"),
                F.lit(0).cast("long").alias("predicted"),
                F.lit(0).cast("long").alias("tp"),
            )
            for c in classes
        ],
    )
    summed = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "cls")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
        .filter(F.col("cls").isin(*classes))
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return summed.select(
        *by,
        "cls",
        "tp",
        "support",
        "predicted",
        safe(F.col("tp"), F.col("predicted")).alias("precision"),
        safe(F.col("tp"), F.col("support")).alias("recall"),
        safe(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def averages(classes_df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Macro and weighted averages and accuracy from the per-class table.

    Macro means run over classes that occur as truth or prediction.
    """
    seen = (F.col("support") + F.col("predicted")) > 0
    return classes_df.groupBy(*by).agg(
        *[F.avg(F.when(seen, F.col(m))).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
    )


def classification_report(
    df: DataFrame, y: str, pred: str, classes: list, by: list[str] = ()
) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted rows (long form)."""
    by = list(by)
    rows = per_class(pair_counts(df, y, pred, by), classes, by)
    total = averages(rows, by)
    as_row = lambda name, p, r, f: total.select(
        *by, F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        F.col("n").alias("support"),
    )
    acc = F.col("accuracy")
    return (
        rows.select(*by, F.col("cls").cast("string").alias("class"), "precision", "recall", "f1", "support")
        .unionByName(as_row("accuracy", acc, acc, acc))
        .unionByName(
            as_row("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1"))
        )
        .unionByName(
            as_row(
                "weighted avg",
                F.col("weighted_precision"),
                F.col("weighted_recall"),
                F.col("weighted_f1"),
            )
        )
    )


def fold_report(df: DataFrame, fold: str, y: str, pred: str, classes: list) -> DataFrame:
    """Macro-F1, accuracy and row count per fold."""
    rows = per_class(pair_counts(df, y, pred, [fold]), classes, [fold])
    return averages(rows, [fold]).select(fold, "macro_f1", "accuracy", "n")


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: list, wide: bool = False) -> DataFrame:
    """All C x C cells, long or with one column per predicted class."""
    pairs = pair_counts(df, y, pred)
    empty = (
        df.sparkSession.range(1)
        .select(_class_rows(classes).alias("y"))
        .select("y", _class_rows(classes).alias("pred"), F.lit(0).cast("long").alias("n"))
    )
    cells = pairs.unionByName(empty).groupBy("y", "pred").agg(F.sum("n").alias("n"))
    cells = cells.filter(F.col("y").isin(*classes) & F.col("pred").isin(*classes))
    if not wide:
        return cells
    return cells.groupBy("y").agg(
        *[F.sum(F.when(F.col("pred") == c, F.col("n"))).alias(f"pred_{c}") for c in classes]
    )


def assemble_oof(manifest: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Attach predictions to the manifest; each covered row must be predicted once.

    Adds ``times`` (predictions found) and ``covered`` (exactly one).
    """
    counted = preds.withColumn("times", F.lit(1).cast("long"))
    cols = [c for c in preds.columns if c != key]
    once = counted.groupBy(key).agg(
        F.sum("times").alias("times"), *[F.min(c).alias(c) for c in cols]
    )
    joined = manifest.join(once, key, "left")
    return joined.withColumn("times", F.coalesce("times", F.lit(0).cast("long"))).withColumn(
        "covered", F.col("times") == 1
    )


def bias_sweep(
    oof: DataFrame, y: str, logits: str, cls: int, classes: list, lo=-3.0, hi=1.0, steps=81
) -> DataFrame:
    """Try additive biases on one class's score and keep the best macro-F1.

    Only a strict improvement over no bias counts, and the lowest bias wins
    among equals. A row's prediction turns from the best other class to ``cls`` at
    one bias and stays there, so it is counted once, by truth, other class and the
    number of biases below that point; running sums over the biases give all
    their confusion tables.
    """
    step = (hi - lo) / (steps - 1)
    biases = [lo + i * step for i in range(steps)]
    z = F.col(logits)
    rest = F.transform(z, lambda v, i: F.when(i != cls, v))
    row = F.struct(F.get(z, cls).alias("own"), F.array_max(rest).alias("top"), argmax(rest).alias("other"))

    def wins(r: Column, bias: Column) -> Column:
        moved = r["own"] + bias
        better = (moved > r["top"]) | ((moved == r["top"]) & (F.lit(cls) < r["other"]))
        return F.when(r["top"].isNull(), moved.isNotNull()).otherwise(F.coalesce(better, F.lit(False)))

    tries = F.array(*[F.lit(b) for b in biases])
    turn = let(row, lambda r: F.struct(r["other"].alias("other"), F.size(F.filter(tries, lambda b: ~wins(r, b))).alias("below"), wins(r, F.lit(0.0)).alias("base")))
    turns = oof.select(F.col(y).alias("y"), turn.alias("t")).select("y", "t.*")
    counted = turns.groupBy("y", "other", "below", "base").agg(F.count("*").alias("n"))
    # from here on a table of fixed size: one list for each truth and other class
    lists = counted.groupBy("y", "other").agg(F.sum("n").alias("all"), F.collect_list(F.struct("below", "base", "n")).alias("at"))

    def table(i: Column) -> Column:
        own = F.filter("at", lambda x: F.when(i < 0, x["base"]).otherwise(x["below"] <= i))
        own = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return F.struct(i.alias("i"), F.when(i < 0, 0.0).otherwise(F.get(tries, i)).alias("bias"), own.alias("own"))

    # i = -1 is the unbiased row; being first it also wins every tie
    every = F.transform(F.sequence(F.lit(-1), F.lit(steps - 1)), table)
    sides = F.array(F.struct(F.lit(cls).alias("pred"), F.col("own").alias("n")), F.struct(F.col("other").alias("pred"), (F.col("all") - F.col("own")).alias("n")))
    tried = lists.select("y", "other", "all", F.inline(every)).select("i", "bias", "y", F.inline(sides)).filter("n > 0")
    by = ["i", "bias"]
    scores = averages(per_class(tried, classes, by), by).select(
        *by, F.round("macro_f1", 12).alias("f1")
    )
    best = F.max_by(
        F.struct("bias", "f1"), F.struct(F.col("f1"), -F.col("i"), -F.col("bias"))
    ).alias("best")
    return scores.agg(best, F.max(F.when(F.col("i") == -1, F.col("f1"))).alias("base_macro_f1")).select(
        F.col("best.bias").alias("bias"), "base_macro_f1", F.col("best.f1").alias("macro_f1")
    )


def average_predictions(df: DataFrame, key: str, arr: str, space: str) -> DataFrame:
    """Average several predictions per key.

    ``probability``: mean of probabilities, floored, log taken; ``logit``: sum.
    """
    long = df.select(key, F.posexplode(arr).alias("pos", "v"))
    value = F.log(F.greatest(F.avg("v"), F.lit(1e-8))) if space == "probability" else F.sum("v")
    per_pos = long.groupBy(key, "pos").agg(value.alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return per_pos.groupBy(key).agg(F.transform(packed, lambda s: s["v"]).alias(arr))


def soft_ce(oof: DataFrame, logits: str, targets: str, weights: list[float], by: list[str] = ()) -> DataFrame:
    return oof.groupBy(*by).agg(
        F.avg(soft_cross_entropy(F.col(logits), F.col(targets), weights)).alias("soft_ce")
    )


def rank_mse(oof: DataFrame, logits: str, label: str, ordinal: tuple[int, ...], by: list[str] = ()) -> DataFrame:
    """Squared error of the expected rank over rows on the ordered axis; 0 without any."""
    error = F.when(
        F.col(label).isin(*ordinal), F.pow(expected_rank(F.col(logits), ordinal) - F.col(label), 2)
    )
    return oof.groupBy(*by).agg(F.coalesce(F.avg(error), F.lit(0.0)).alias("rank_mse"))


def compare_to_targets(results: DataFrame, targets: DataFrame, rules: list[dict]) -> DataFrame:
    """Deltas of the latest matching result of each stored target.

    A rule is ``{when, contains, lacks}``: targets whose scenario contains
    ``when`` look for results whose scenario contains ``contains`` and not
    ``lacks``; targets no rule names fall back on equal inputs. ``results``
    needs a ``run_order`` column; the last match counts. Rules become match
    keys on both sides, so the comparison is an equi-join.
    """
    name = F.lower(F.col("scenario"))
    by_input = F.concat(F.lit("input:"), F.lower(F.col("input")))
    offered = [by_input]
    wanted = by_input
    for i, r in reversed(list(enumerate(rules))):
        fits = name.contains(r["contains"].lower())
        if r.get("lacks"):
            fits = fits & ~name.contains(r["lacks"].lower())
        offered.append(F.when(fits, F.lit(f"rule:{i}")))
        wanted = F.when(F.col("scenario").contains(r["when"]), F.lit(f"rule:{i}")).otherwise(wanted)
    current = results.select(F.explode(F.array_compact(F.array(*offered))).alias("_key"), "macro_f1", "run_order")
    ruled = targets.select(
        wanted.alias("_key"),
        F.col("scenario").alias("reference_scenario"),
        F.col("macro_f1").alias("reference_macro_f1"),
    )
    return (
        current.join(ruled, "_key")
        .groupBy("reference_scenario", "reference_macro_f1")
        .agg(F.max_by("macro_f1", "run_order").alias("current_macro_f1"))
        .withColumn("delta", F.col("current_macro_f1") - F.col("reference_macro_f1"))
    )


def error_rows(oof: DataFrame, y: str, pred: str, pairs: list[tuple], id_col: str, n: int) -> DataFrame:
    """First n rows, by id, of each listed (truth, prediction) confusion."""
    wanted = F.lit(False)
    for a, b in pairs:
        wanted = wanted | ((F.col(y) == a) & (F.col(pred) == b))
    order = Window.partitionBy(y, pred).orderBy(id_col)
    return oof.filter(wanted).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def stack_results(parts: list[DataFrame]) -> DataFrame:
    """Union of result tables with differing columns; missing ones become NULL."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked
