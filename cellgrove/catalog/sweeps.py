"""Sweep queries (section J) over the masked rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.evaluation import COUNTS
from cellgrove.catalog.evaluation import counts as image_counts
from cellgrove.catalog.fixtures import MASKED, SEED, masked_cells, rounded
from cellgrove.operators import sweep as J
from cellgrove.operators.cells import join_stats
from cellgrove.operators.evaluate import confusion_counts, overlap_metrics
from cellgrove.operators.folds import stratified_split
from cellgrove.session import cut

DENSITIES = [0.08, 0.10, 0.12, 0.14, 0.16, 0.18]
QS = ", ".join(f"quantile_cont(v, 1.0 - {d}) AS q{i}" for i, d in enumerate(DENSITIES))
SWEPT = f"""WITH {MASKED}, q AS (SELECT image_id, {QS} FROM cells WHERE fov GROUP BY image_id),
d AS (SELECT * FROM (VALUES {', '.join(f'({i}, {d}::DOUBLE)' for i, d in enumerate(DENSITIES))}) t(i, density)),
ev AS (SELECT density, image_id, gt, v >= CASE i {' '.join(f'WHEN {i} THEN q{i}' for i in range(len(DENSITIES)))} END AS p FROM masked JOIN q USING (image_id) CROSS JOIN d WHERE fov),
ct AS (SELECT density, image_id, count(*) FILTER (p AND gt) AS tp, count(*) FILTER (p AND NOT gt) AS fp, count(*) FILTER (NOT p AND gt) AS fn, count(*) FILTER (NOT p AND NOT gt) AS tn FROM ev GROUP BY ALL)"""
G = "CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END"
PREC, SENS = G.format(n="tp", d="(tp + fp)"), G.format(n="tp", d="(tp + fn)")
ACC, DICE = G.format(n="(tp + tn)", d="(tp + fp + fn + tn)"), G.format(n="(2 * tp)", d="(2 * tp + fp + fn)")
POOLED = f"""{SWEPT}, pl AS (SELECT density, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn, count(*) AS sample_count,
  avg({PREC}) AS mean_precision, avg({SENS}) AS mean_sensitivity, avg({ACC}) AS mean_accuracy, avg({DICE}) AS mean_dice FROM ct GROUP BY density),
res AS (SELECT *, {PREC} AS precision, {SENS} AS sensitivity, {ACC} AS accuracy, {DICE} AS dice FROM pl)"""


def sweep(read):
    return J.evaluate_densities(masked_cells(read), "v", "gt", "fov", DENSITIES)


def called_sweep(read):
    """The same through a user's function over configurations."""
    samples = masked_cells(read).drop("pred")
    configs = J.param_grid(samples.sparkSession, {"density": DENSITIES})
    cutoffs = J.cutoffs_by_density(samples, "v", "fov", DENSITIES)
    pick = lambda df: df.withColumn("pred", F.col("v") >= F.col("cutoffs")[F.col("cfg.density")])
    return J.evaluate_grid(configs, join_stats(samples, cutoffs), pick, "gt", "fov")


GRID36 = "SELECT a.d AS density, b.l AS low_mult, c.h AS high_mult FROM (SELECT unnest([0.095, 0.105, 0.115, 0.125]::DOUBLE[]) AS d) a, (SELECT unnest([1.15, 1.30, 1.45]::DOUBLE[]) AS l) b, (SELECT unnest([0.50, 0.60, 0.70]::DOUBLE[]) AS h) c"


def grid36(spark):
    return J.param_grid(
        spark, {"density": [0.095, 0.105, 0.115, 0.125], "low_mult": [1.15, 1.30, 1.45], "high_mult": [0.50, 0.60, 0.70]}
    )


@query("J1_param_grid", f"WITH n AS (SELECT count(*) AS images FROM embeddings), g AS ({GRID36}) SELECT density, low_mult, high_mult, residual, images FROM g, n, (SELECT unnest([true, false]) AS residual) r")
def _(read):
    images = read("embeddings").agg(F.count("*").alias("images"))
    grid = J.extend_grid(grid36(images.sparkSession), {"residual": [True, False]})
    return grid.select("*", images.scalar().alias("images"))


#: Fixed values of the second grid, one list a parameter.
RECOVERY = {
    "residual_low_mult": [1.10, 1.22, 1.35, 1.50],
    "axis_ratio": [2.0, 2.3, 2.6],
    "skeleton_length": [8, 12, 18],
    "branch_density": [0.10, 0.15, 0.20],
}


@query(
    "J1_derived_grid",
    f"""{POOLED}, b AS (SELECT density FROM (SELECT density FROM res ORDER BY dice DESC, density LIMIT 1) UNION SELECT density FROM (SELECT density FROM res ORDER BY sensitivity DESC, density LIMIT 1))
SELECT density, dice, sensitivity, {', '.join(f'{n} AS {n}' for n in RECOVERY)} FROM (SELECT density, round(dice, 6) AS dice, round(sensitivity, 6) AS sensitivity FROM res WHERE density IN (SELECT density FROM b)),
{', '.join(f"(SELECT unnest({v}::{'INTEGER' if n == 'skeleton_length' else 'DOUBLE'}[]) AS {n})" for n, v in RECOVERY.items())}""",
)
def _(read):
    res = cut(sweep(read))
    bases = res.join(J.shortlist(res, "density", ["dice", "sensitivity"], 1), "density", "left_semi")
    return J.extend_grid(rounded(bases.select("density", "dice", "sensitivity")), RECOVERY)


@query(
    "J2_dedupe_configs",
    """SELECT l_discount, l_tax, l_returnflag, first_line FROM (SELECT round(l_discount + 0.000001, 5) AS l_discount, round(l_tax, 5) AS l_tax, l_returnflag,
  min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2, 3)""",
)
def _(read):
    noisy = read("lineitem").select(
        (F.col("l_discount") + 0.000001).alias("l_discount"), "l_tax", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_line")
    )
    return J.dedupe_configs(noisy, ["l_discount", "l_tax", "l_returnflag"], "first_line")


@query(
    "J3_evaluate_grid",
    f"""{POOLED} SELECT density, tp, fp, fn, tn, sample_count, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_precision', 'mean_sensitivity', 'mean_accuracy', 'mean_dice', 'precision', 'sensitivity', 'accuracy', 'dice'))} FROM res""",
)
def _(read):
    return rounded(sweep(read))


@query(
    "J3_user_function",
    f"""{POOLED} SELECT density, tp, fp, fn, tn, sample_count, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_precision', 'mean_sensitivity', 'mean_accuracy', 'mean_dice', 'precision', 'sensitivity', 'accuracy', 'dice'))} FROM res""",
)
def _(read):
    return rounded(called_sweep(read))


@query(
    "J4_shortlist",
    f"""{POOLED}, f AS (SELECT * FROM res WHERE precision >= 0.9 OR (SELECT count(*) FROM res WHERE precision >= 0.9) = 0),
s AS (SELECT density FROM (SELECT density FROM f ORDER BY dice DESC, density LIMIT 2) UNION SELECT density FROM (SELECT density FROM f ORDER BY sensitivity DESC, density LIMIT 2)),
x AS (SELECT density, dice * 2 AS costly FROM res WHERE density IN (SELECT density FROM s))
SELECT density, round(res.dice, 6) AS dice, round(costly, 6) AS costly, x.density IS NOT NULL AS evaluated FROM res LEFT JOIN x USING (density)""",
)
def _(read):
    res = sweep(read)
    chosen = J.shortlist(res, "density", ["dice", "sensitivity"], 2, ("precision", 0.9))
    costly = res.join(chosen, "density", "left_semi").select("density", (F.col("dice") * 2).alias("costly"))
    return rounded(J.merge_expensive(res, costly, "density").select("density", "dice", "costly", "evaluated"))


@query(
    "J5_leaderboards",
    f"""{POOLED}, l AS (SELECT density, 'dice' AS metric, dice AS score FROM res UNION ALL SELECT density, 'precision', precision FROM res UNION ALL SELECT density, 'sensitivity', sensitivity FROM res),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, density) AS rank FROM l)
SELECT density, metric, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def _(read):
    return rounded(J.leaderboards(sweep(read), "density", ["dice", "precision", "sensitivity"], 3))


def per_image(read):
    """Dice per density and image, with each image's split."""
    samples = masked_cells(read).drop("pred")
    cutoffs = J.cutoffs_by_density(samples, "v", "fov", DENSITIES)
    tried = J.attach_configs(join_stats(samples, cutoffs), J.param_grid(samples.sparkSession, {"density": DENSITIES}))
    tried = tried.withColumn("pred", F.col("v") >= F.col("cutoffs")[F.col("cfg.density")])
    counts = confusion_counts(tried, ["cfg", "image_id"], "pred", "gt", "fov")
    dice = overlap_metrics(counts).select(F.col("cfg.density").alias("density"), "image_id", "dice")
    images = read("embeddings").select(F.col("vec_id").alias("image_id"), "label")
    split = stratified_split(images, ["label"], "image_id", 0.4, SEED).select("image_id", "split")
    return dice.join(split, "image_id")


@query(
    "J6_tune_validate",
    f"""{SWEPT}, r AS (SELECT vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat(vec_id, ':{SEED}')), vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
sp AS (SELECT image_id, CASE WHEN rn <= round_even(n * 0.4, 0) THEN 'test' ELSE 'train' END AS split FROM r),
m AS (SELECT density, avg({DICE}) FILTER (split = 'train') AS train, avg({DICE}) FILTER (split = 'test') AS test FROM ct JOIN sp USING (image_id) GROUP BY density)
SELECT density, round(train, 4) AS train, round(test, 4) AS test FROM m ORDER BY m.train DESC, density DESC LIMIT 3""",
)
def _(read):
    return J.tune_validate(per_image(read), "density", "split", "dice", 3)


@query(
    "J7_best_worst",
    f"""{COUNTS}, d AS (SELECT image_id, round({DICE}, 6) AS dice FROM counts)
SELECT image_id, dice, 'best' AS rank_group FROM (SELECT * FROM d ORDER BY dice DESC, image_id LIMIT 5)
UNION ALL SELECT image_id, dice, 'worst' FROM (SELECT * FROM d ORDER BY dice, image_id LIMIT 5)""",
)
def _(read):
    dice = overlap_metrics(image_counts(read)).select("image_id", F.round("dice", 6).alias("dice"))
    return J.best_worst(dice, "image_id", "dice", 5)


@query(
    "J8_ablation_table",
    """WITH a AS (SELECT l_returnflag AS opt, l_linestatus AS st, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT opt, max(v) FILTER (st = 'F') AS "F", max(v) FILTER (st = 'O') AS "O" FROM a GROUP BY opt), b AS (SELECT v FROM a WHERE opt = 'N' AND st = 'F')
SELECT opt, round("F", 6) AS "F", round("O", 6) AS "O", round("F" - b.v, 6) + 0.0 AS "F_delta", round("O" - b.v, 6) + 0.0 AS "O_delta" FROM w, b""",
)
def _(read):
    means = read("lineitem").groupBy(F.col("l_returnflag").alias("opt"), F.col("l_linestatus").alias("st")).agg(F.avg("l_quantity").alias("v"))
    return rounded(J.ablation_table(means, "opt", "st", "v", ["F", "O"], ("N", "F")))
