"""Overlap metrics of masks and their poolings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.cells import SIZE
from cellgrove.operators.quantiles import group_stats

EPS = 1e-8


def confusion_counts(
    df: DataFrame, by: list[str], pred: str, gt: str, region: str | None = None
) -> DataFrame:
    """tp, fp, fn, tn per group, optionally inside a region only."""
    rows = df.filter(F.col(region)) if region else df
    p, g = F.col(pred), F.col(gt)
    return rows.groupBy(*by).agg(
        F.count_if(p & g).alias("tp"),
        F.count_if(p & ~g).alias("fp"),
        F.count_if(~p & g).alias("fn"),
        F.count_if(~p & ~g).alias("tn"),
    )


def _ratio(num: Column, den: Column, rule: str) -> Column:
    if rule == "epsilon":
        return num / (den + EPS)
    if rule == "guarded":
        return F.when(den > 0, num / den).otherwise(0.0)
    if rule == "floor_one":
        return num / F.greatest(den, F.lit(1))
    raise ValueError(rule)


def metric_columns(rule: str) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return {
        "dice": _ratio(2 * tp, 2 * tp + fp + fn, rule),
        "iou": _ratio(tp, tp + fp + fn, rule),
        "precision": _ratio(tp, tp + fp, rule),
        "sensitivity": _ratio(tp, tp + fn, rule),
        "specificity": _ratio(tn, tn + fp, rule),
        "accuracy": _ratio(tp + tn, n, rule),
        "pred_density": _ratio(tp + fp, n, "guarded"),
        "gt_density": _ratio(tp + fn, n, "guarded"),
    }


def overlap_metrics(counts: DataFrame, rule: str = "guarded") -> DataFrame:
    """Metrics from counts; ``rule`` is the treatment of empty denominators."""
    return counts.withColumns(metric_columns(rule))


def pool_metrics(counts: DataFrame, by: list[str], rule: str = "guarded") -> DataFrame:
    """Metrics of the summed counts next to the mean of per-image metrics, in one pass."""
    per_image = metric_columns(rule)
    names = ("precision", "sensitivity", "accuracy", "dice")
    pooled = counts.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[F.avg(per_image[m]).alias(f"mean_{m}") for m in names],
        F.count("*").alias("sample_count"),
    )
    return pooled.withColumns({m: per_image[m] for m in names})


def centreline_dice(
    df: DataFrame, by: list[str], pred: str, gt: str, pred_skel: str, gt_skel: str
) -> DataFrame:
    """Precision of the predicted centre line, recall of the true one, their mean."""
    hit = df.groupBy(*by).agg(
        F.count_if(F.col(pred_skel)).alias("pred_len"),
        F.count_if(F.col(gt_skel)).alias("gt_len"),
        F.count_if(F.col(pred_skel) & F.col(gt)).alias("pred_hit"),
        F.count_if(F.col(gt_skel) & F.col(pred)).alias("gt_hit"),
    )
    rated = hit.withColumns(
        {
            "cl_precision": _ratio(F.col("pred_hit"), F.col("pred_len"), "guarded"),
            "cl_recall": _ratio(F.col("gt_hit"), F.col("gt_len"), "guarded"),
        }
    )
    p, r = F.col("cl_precision"), F.col("cl_recall")
    return rated.withColumn("cldice", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def recall_at_density(df: DataFrame, value: str, gt: str, region: str, density: float) -> DataFrame:
    """Share of the truth covered by the top ``density`` of the response."""
    cutoff = group_stats(
        df,
        ["image_id"],
        {"cutoff": (F.when(F.col(region), F.col(value)), 1.0 - density)},
        size=SIZE,
    )
    hit = F.col(region) & F.col(gt) & (F.col(value) >= F.col("cutoff"))
    return (
        df.join(cutoff, "image_id")
        .groupBy("image_id")
        .agg(F.count_if(hit).alias("_hit"), F.count_if(F.col(gt)).alias("_gt"))
        .select("image_id", _ratio(F.col("_hit"), F.col("_gt"), "guarded").alias("recall"))
    )


def separation_ratio(df: DataFrame, value: str, gt: str, region: str) -> DataFrame:
    """Mean response on the truth over mean response on the background."""
    on = F.when(F.col(region) & F.col(gt), F.col(value))
    off = F.when(F.col(region) & ~F.col(gt), F.col(value))
    means = df.groupBy("image_id").agg(F.avg(on).alias("_on"), F.avg(off).alias("_off"))
    return means.select(
        "image_id",
        F.coalesce(F.col("_on") / (F.col("_off") + 1e-6), F.lit(0.0)).alias("separation"),
    )


def summarise(df: DataFrame, by: list[str], cols: list[str], rollup: bool = False) -> DataFrame:
    """Mean of each metric and row count per group, with subtotals on request."""
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))
