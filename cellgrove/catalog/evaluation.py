"""Evaluation queries (section I) and the class-axis expressions they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CLASSES, LABELS, MASKED, OOF, masked_cells, oof, rounded
from cellgrove.functions import logits as L
from cellgrove.operators import evaluate as E
from cellgrove.operators import report as R

COUNTS = f"""WITH {MASKED}, counts AS (
  SELECT image_id, count(*) FILTER (pred AND gt) AS tp, count(*) FILTER (pred AND NOT gt) AS fp,
         count(*) FILTER (NOT pred AND gt) AS fn, count(*) FILTER (NOT pred AND NOT gt) AS tn
  FROM masked WHERE fov GROUP BY image_id)"""


def counts(read):
    return E.confusion_counts(masked_cells(read), ["image_id"], "pred", "gt", "fov")


@query("I1_confusion_counts", COUNTS + " SELECT * FROM counts")
def _(read):
    return counts(read)


def _ratios(rule):
    wrap = {
        "epsilon": "CAST({n} AS DOUBLE) / ({d} + 1e-8)",
        "guarded": "CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0 END",
        "floor_one": "CAST({n} AS DOUBLE) / greatest({d}, 1)",
    }
    parts = {
        "dice": ("(2 * tp)", "(2 * tp + fp + fn)", rule),
        "iou": ("tp", "(tp + fp + fn)", rule),
        "precision": ("tp", "(tp + fp)", rule),
        "sensitivity": ("tp", "(tp + fn)", rule),
        "specificity": ("tn", "(tn + fp)", rule),
        "accuracy": ("(tp + tn)", "(tp + fp + fn + tn)", rule),
        "pred_density": ("(tp + fp)", "(tp + fp + fn + tn)", "guarded"),
        "gt_density": ("(tp + fn)", "(tp + fp + fn + tn)", "guarded"),
    }
    return {k: wrap[r].format(n=n, d=d) for k, (n, d, r) in parts.items()}


def _metric_sql(rule):
    cols = ", ".join(f"round({e}, 6) AS {k}" for k, e in _ratios(rule).items())
    return f"{COUNTS} SELECT image_id, tp, fp, fn, tn, {cols} FROM counts"


for _rule in ("guarded", "epsilon", "floor_one"):

    @query(f"I2_overlap_metrics_{_rule}", _metric_sql(_rule))
    def _(read, rule=_rule):
        return rounded(E.overlap_metrics(counts(read), rule))


_G = _ratios("guarded")


@query(
    "I3_pool_metrics",
    f"""{COUNTS}, pooled AS (
  SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
         CAST(sum(tn) AS BIGINT) AS tn, count(*) AS sample_count,
         round(avg({_G['precision']}), 6) AS mean_precision, round(avg({_G['sensitivity']}), 6) AS mean_sensitivity,
         round(avg({_G['accuracy']}), 6) AS mean_accuracy, round(avg({_G['dice']}), 6) AS mean_dice FROM counts)
SELECT *, round({_G['precision']}, 6) AS precision, round({_G['sensitivity']}, 6) AS sensitivity,
  round({_G['accuracy']}, 6) AS accuracy, round({_G['dice']}, 6) AS dice FROM pooled""",
)
def _(read):
    return rounded(E.pool_metrics(counts(read), []))


@query("I4_centreline_dice")
def _(read):
    from cellgrove.operators.skeleton import thin

    skel = thin(thin(masked_cells(read), "pred", "pred_skel"), "gt", "gt_skel")
    return rounded(E.centreline_dice(skel, ["image_id"], "pred", "gt", "pred_skel", "gt_skel"))


@query(
    "I4_centreline_dice_given_lines",
    f"""WITH {MASKED}, lines AS (SELECT *, pred AND (y + x) % 2 = 0 AS ps, gt AND (y + x) % 2 = 0 AS gs FROM masked),
hits AS (SELECT image_id, count(*) FILTER (ps) AS pred_len, count(*) FILTER (gs) AS gt_len,
  count(*) FILTER (ps AND gt) AS pred_hit, count(*) FILTER (gs AND pred) AS gt_hit FROM lines GROUP BY image_id),
rated AS (SELECT *, CASE WHEN pred_len > 0 THEN CAST(pred_hit AS DOUBLE) / pred_len ELSE 0.0 END AS p,
  CASE WHEN gt_len > 0 THEN CAST(gt_hit AS DOUBLE) / gt_len ELSE 0.0 END AS r FROM hits)
SELECT image_id, pred_len, gt_len, pred_hit, gt_hit, round(p, 6) AS cl_precision, round(r, 6) AS cl_recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS cldice FROM rated""",
)
def _(read):
    alternate = (F.col("y") + F.col("x")) % 2 == 0
    lines = masked_cells(read).withColumns(
        {"ps": F.col("pred") & alternate, "gs": F.col("gt") & alternate}
    )
    return rounded(E.centreline_dice(lines, ["image_id"], "pred", "gt", "ps", "gs"))


@query(
    "I5_recall_at_density",
    f"""WITH {MASKED}, q AS (SELECT image_id, quantile_cont(v, 1.0 - 0.16) AS cutoff FROM cells WHERE fov GROUP BY image_id)
SELECT image_id, round(CASE WHEN count(*) FILTER (gt) > 0 THEN
  CAST(count(*) FILTER (fov AND gt AND v >= cutoff) AS DOUBLE) / count(*) FILTER (gt) ELSE 0.0 END, 6) AS recall
FROM masked JOIN q USING (image_id) GROUP BY image_id""",
)
def _(read):
    return rounded(E.recall_at_density(masked_cells(read), "v", "gt", "fov", 0.16))


@query(
    "I5_separation_ratio",
    f"""WITH {MASKED} SELECT image_id, round(coalesce(avg(v) FILTER (fov AND gt)
  / (avg(v) FILTER (fov AND NOT gt) + 1e-6), 0.0), 6) + 0.0 AS separation FROM masked GROUP BY image_id""",
)
def _(read):
    return rounded(E.separation_ratio(masked_cells(read), "v", "gt", "fov"))


@query(
    "I6_summarise_rollup",
    """SELECT o_orderstatus, o_orderpriority, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS o_totalprice, count(*) AS n
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def _(read):
    priced = read("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    return rounded(E.summarise(priced, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], rollup=True), 4)


PAIRS = f"""WITH {OOF}, per AS (
  SELECT k.cls, count(*) FILTER (label_id = k.cls AND pred = k.cls) AS tp,
    count(*) FILTER (label_id = k.cls) AS support, count(*) FILTER (pred = k.cls) AS predicted
  FROM oof, (SELECT unnest(range(5)) AS cls) k GROUP BY k.cls),
rated AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r,
  CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f FROM per)"""


@query(
    "I7_classification_report",
    PAIRS
    + """, tot AS (SELECT CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc,
  avg(p) FILTER (support + predicted > 0) AS mp, avg(r) FILTER (support + predicted > 0) AS mr,
  avg(f) FILTER (support + predicted > 0) AS mf,
  sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf
  FROM rated)
SELECT CAST(cls AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM rated
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM tot""",
)
def _(read):
    return rounded(R.classification_report(oof(read), "label_id", "pred", CLASSES))


@query(
    "I8_confusion_matrix",
    f"""WITH {OOF} SELECT a.c AS y, b.c AS pred, count(key) AS n
FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS c) a CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS c) b
LEFT JOIN oof ON label_id = a.c AND oof.pred = b.c GROUP BY ALL""",
)
def _(read):
    return R.confusion_matrix(oof(read), "label_id", "pred", CLASSES)


@query(
    "I8_confusion_matrix_wide",
    f"""WITH {OOF} SELECT label_id AS y, {', '.join(f'count(*) FILTER (pred = {c}) AS pred_{c}' for c in CLASSES)}
FROM oof GROUP BY label_id""",
)
def _(read):
    return R.confusion_matrix(oof(read), "label_id", "pred", CLASSES, wide=True)


@query(
    "I9_fold_report",
    f"""WITH {OOF}, per AS (
  SELECT fold, k.cls, count(*) FILTER (label_id = k.cls AND pred = k.cls) AS tp,
    count(*) FILTER (label_id = k.cls) AS support, count(*) FILTER (pred = k.cls) AS predicted
  FROM oof, (SELECT unnest(range(5)) AS cls) k GROUP BY fold, k.cls)
SELECT fold, round(avg(2.0 * tp / (support + predicted)) FILTER (support + predicted > 0), 6) AS macro_f1,
  round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy, CAST(sum(support) AS BIGINT) AS n
FROM per GROUP BY fold""",
)
def _(read):
    return rounded(R.fold_report(oof(read), "fold", "label_id", "pred", CLASSES))


@query(
    "I10_assemble_oof",
    """WITH preds AS (SELECT doc_id, quality AS pred FROM labels)
SELECT d.doc_id, d.lang, p.pred, coalesce(p.times, 0) AS times, coalesce(p.times, 0) = 1 AS covered
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS times, min(pred) AS pred FROM preds GROUP BY doc_id) p
USING (doc_id)""",
)
def _(read):
    preds = read("labels").select("doc_id", F.col("quality").alias("pred"))
    return R.assemble_oof(read("documents").select("doc_id", "lang"), preds, "doc_id")


@query(
    "I11_bias_sweep",
    f"""WITH {OOF}, b AS (SELECT -1 AS i, CAST(0 AS DOUBLE) AS bias UNION ALL
  SELECT CAST(unnest(range(81)) AS INTEGER), CAST(-3.0 AS DOUBLE) + unnest(range(81)) * CAST(0.05 AS DOUBLE)),
tried AS (SELECT i, bias, label_id, [logits[1], logits[2] + bias, logits[3], logits[4], logits[5]] AS z FROM oof, b),
called AS (SELECT i, bias, label_id, list_position(z, list_max(z)) - 1 AS p FROM tried),
per AS (SELECT i, bias, k.cls, count(*) FILTER (label_id = k.cls AND p = k.cls) AS tp,
  count(*) FILTER (label_id = k.cls) AS support, count(*) FILTER (p = k.cls) AS predicted
  FROM called, (SELECT unnest(range(5)) AS cls) k GROUP BY ALL),
f AS (SELECT i, bias, round(avg(2.0 * tp / (support + predicted)) FILTER (support + predicted > 0), 12) AS f1
  FROM per GROUP BY i, bias),
base AS (SELECT f1 AS base_f1 FROM f WHERE i = -1)
SELECT round(bias, 6) + 0.0 AS bias, round(base_f1, 6) AS base_macro_f1, round(f1, 6) AS macro_f1
FROM f, base ORDER BY f1 DESC, i LIMIT 1""",
)
def _(read):
    return rounded(R.bias_sweep(oof(read), "label_id", "logits", 1, CLASSES))


SOFTMAX = "list_transform(logits, lambda z: exp(z - list_max(logits)))"
PROBS = f"probs AS (SELECT *, list_transform(e, lambda q: q / list_sum(e)) AS p FROM (SELECT *, {SOFTMAX} AS e FROM oof))"


@query(
    "I12_shift_calibrate",
    f"""WITH {OOF}, {PROBS},
moved AS (SELECT key, label_id, [p[1], greatest(p[2] - 0.10, 0.0), p[3], p[4], p[5]] AS s FROM probs),
scaled AS (SELECT key, label_id, list_transform(s, lambda q: round(q / greatest(list_sum(s), 1e-8), 9)) AS s FROM moved)
SELECT key, label_id, round(s[2], 6) AS p1, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred_calibrated FROM scaled""",
)
def _(read):
    moved = L.shift_probability(L.softmax(F.col("logits")), 1, -0.10)
    shifted = oof(read).select("key", "label_id", F.transform(moved, lambda v: F.round(v, 9)).alias("s"))
    return shifted.select(
        "key", "label_id", F.round(F.col("s")[1], 6).alias("p1"), L.argmax(F.col("s")).alias("pred_calibrated")
    )


VIEWS = """views AS (
  SELECT vec_id AS key, CAST(embedding[1:5] AS DOUBLE[]) AS logits FROM embeddings
  UNION ALL SELECT vec_id, CAST(embedding[6:10] AS DOUBLE[]) FROM embeddings)"""


@query(
    "I13_average_predictions",
    f"""WITH {VIEWS}, p AS (SELECT key, list_transform(e, lambda q: q / list_sum(e)) AS p
  FROM (SELECT key, {SOFTMAX} AS e FROM views)),
m AS (SELECT key, i, ln(greatest(avg(p[i]), 1e-8)) AS v FROM p, range(1, 6) t(i) GROUP BY key, i)
SELECT key, round(max(v) FILTER (i = 1), 6) + 0.0 AS a0, round(max(v) FILTER (i = 5), 6) + 0.0 AS a4,
  CAST(arg_max(i, (round(v, 9), -i)) - 1 AS INTEGER) AS pred FROM m GROUP BY key""",
)
def _(read):
    part = lambda start: read("embeddings").select(
        F.col("vec_id").alias("key"),
        L.softmax(F.transform(F.slice("embedding", start, 5), lambda v: v.cast("double"))).alias("p"),
    )
    mean = R.average_predictions(part(1).unionByName(part(6)), "key", "p", "probability")
    return mean.select(
        "key",
        F.round(F.col("p")[0], 6).alias("a0"),
        F.round(F.col("p")[4], 6).alias("a4"),
        L.argmax(F.transform("p", lambda v: F.round(v, 9))).alias("pred"),
    )


@query(
    "I14_soft_ce",
    f"""WITH {OOF}, rows AS (SELECT fold, label_id,
  list_transform(logits, lambda z: z - list_max(logits)
    - ln(list_sum(list_transform(logits, lambda q: exp(q - list_max(logits)))))) AS lp FROM oof)
SELECT fold, round(avg(-(
  {' + '.join(f"{w} * CASE WHEN label_id = {i} THEN 0.9 ELSE 0.025 END * lp[{i + 1}]" for i, w in enumerate((0.9, 2.3, 1.3, 0.8, 0.6)))}
)), 6) AS soft_ce FROM rows GROUP BY fold""",
)
def _(read):
    table = oof(read).withColumn("q", L.soft_targets(F.col("label_id"), 5, 0.1))
    return rounded(R.soft_ce(table, "logits", "q", [0.9, 2.3, 1.3, 0.8, 0.6], ["fold"]))


@query(
    "I14_rank_mse",
    f"""WITH {OOF}, {PROBS},
axis AS (SELECT fold, label_id, p[1] + p[2] + p[3] + p[4] AS s, p[2] + 2 * p[3] + 3 * p[4] AS w FROM probs)
SELECT fold, round(coalesce(avg(pow(w / greatest(s, 1e-8) - label_id, 2)) FILTER (label_id <= 3), 0.0), 6) AS rank_mse
FROM axis GROUP BY fold""",
)
def _(read):
    return rounded(R.rank_mse(oof(read), "logits", "label_id", (0, 1, 2, 3), ["fold"]))


RESULTS = """results AS (
  SELECT CASE fold % 3 WHEN 0 THEN 'scores softmap' WHEN 1 THEN 'scores softmap calibrated' ELSE 'scores RGB' END AS scenario,
    CASE fold % 3 WHEN 2 THEN 'rgb' ELSE 'softmap' END AS input, avg(CAST(label_id = pred AS DOUBLE)) AS macro_f1,
    fold AS run_order FROM oof GROUP BY fold),
targets AS (SELECT * FROM (VALUES ('calibrated scores', 'Softmap', 0.21), ('scores softmap', 'Softmap', 0.22),
  ('other', 'RGB', 0.19), ('unmatched', 'none', 0.5)) t(scenario, input, macro_f1))"""


@query(
    "I15_compare_to_targets",
    f"""WITH {OOF}, {RESULTS}, m AS (
  SELECT t.scenario AS reference_scenario, t.macro_f1 AS reference_macro_f1, r.macro_f1 AS got, r.run_order
  FROM targets t JOIN results r ON CASE
    WHEN t.scenario LIKE '%calibrated%' THEN r.scenario LIKE '%calibrated%'
    WHEN t.scenario LIKE '%softmap%' THEN r.scenario LIKE '%softmap%' AND r.scenario NOT LIKE '%calibrated%'
    ELSE lower(r.input) = lower(t.input) END)
SELECT reference_scenario, CAST(reference_macro_f1 AS DOUBLE) AS reference_macro_f1,
  round(arg_max(got, run_order), 6) AS current_macro_f1,
  round(arg_max(got, run_order) - reference_macro_f1, 6) + 0.0 AS delta FROM m GROUP BY m.reference_scenario, m.reference_macro_f1""",
)
def _(read):
    turn = F.col("fold") % 3
    table = oof(read)
    results = table.groupBy("fold").agg(
        F.avg((F.col("label_id") == F.col("pred")).cast("double")).alias("macro_f1")
    ).select(
        F.when(turn == 0, "scores softmap").when(turn == 1, "scores softmap calibrated").otherwise("scores RGB").alias("scenario"),
        F.when(turn == 2, "rgb").otherwise("softmap").alias("input"),
        "macro_f1",
        F.col("fold").alias("run_order"),
    )
    targets = table.sparkSession.createDataFrame(
        [("calibrated scores", "Softmap", 0.21), ("scores softmap", "Softmap", 0.22), ("other", "RGB", 0.19), ("unmatched", "none", 0.5)],
        "scenario string, input string, macro_f1 double",
    )
    rules = [
        {"when": "calibrated", "contains": "calibrated"},
        {"when": "softmap", "contains": "softmap", "lacks": "calibrated"},
    ]
    return rounded(R.compare_to_targets(results, targets, rules))


@query(
    "I16_error_rows",
    f"""WITH {OOF}, r AS (SELECT key, label_id, pred, row_number() OVER (PARTITION BY label_id, pred ORDER BY key) AS rn
  FROM oof WHERE (label_id = 1 AND pred = 2) OR (label_id = 2 AND pred = 1))
SELECT key, label_id, pred, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 8""",
)
def _(read):
    rows = R.error_rows(oof(read), "label_id", "pred", [(1, 2), (2, 1)], "key", 8)
    return rows.select("key", "label_id", "pred", "rn")


@query(
    "I17_stack_results",
    f"""WITH {OOF} SELECT 'all' AS scenario, count(*) AS n, NULL::INTEGER AS fold, round(avg(CAST(label_id = pred AS DOUBLE)), 6) AS accuracy FROM oof
UNION ALL SELECT 'fold', NULL, fold, round(avg(CAST(label_id = pred AS DOUBLE)), 6) FROM oof GROUP BY fold""",
)
def _(read):
    hit = F.avg((F.col("label_id") == F.col("pred")).cast("double")).alias("accuracy")
    table = oof(read)
    whole = table.agg(F.count("*").alias("n"), hit).withColumn("scenario", F.lit("all"))
    folds = table.groupBy("fold").agg(hit).withColumn("scenario", F.lit("fold"))
    return rounded(R.stack_results([whole, folds]))


@query(
    "C11_soft_targets_smoothed",
    f"""WITH {OOF} SELECT key, {', '.join(f'round(CASE WHEN label_id = {i} THEN 0.9 ELSE 0.1 / 4 END, 6) AS q{i}' for i in range(5))} FROM oof""",
)
def _(read):
    q = oof(read).select("key", L.soft_targets(F.col("label_id"), 5, 0.1).alias("q"))
    return q.select("key", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(5)])


def _ordinal(i):
    ends = {0: 1, 1: 2, 2: 2, 3: 1}
    cases = [f"WHEN label_id = {i} THEN {'0.9' if i == 4 else '1.0 - 0.2 - 0.1'}"]
    cases += [f"WHEN label_id = {j} THEN 0.025 + 0.2 / {ends[j]}" for j in (i - 1, i + 1) if j in ends and i in ends]
    return f"round(CAST(CASE {' '.join(cases)} ELSE 0.025 END AS DOUBLE), 6) AS q{i}"


@query("C11_soft_targets_ordinal", f"WITH {OOF} SELECT key, {', '.join(map(_ordinal, range(5)))} FROM oof")
def _(read):
    q = oof(read).select("key", L.soft_targets(F.col("label_id"), 5, 0.1, 0.2, (0, 1, 2, 3)).alias("q"))
    return q.select("key", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(5)])


@query(
    "C12_softmax_argmax",
    f"""WITH {OOF}, {PROBS} SELECT key, pred, round(p[1], 6) AS p0, round(p[5], 6) AS p4, round(ln(p[3]), 6) AS lp2 FROM probs""",
)
def _(read):
    z = F.col("logits")
    return oof(read).select(
        "key",
        "pred",
        F.round(L.softmax(z)[0], 6).alias("p0"),
        F.round(L.softmax(z)[4], 6).alias("p4"),
        F.round(L.log_softmax(z)[2], 6).alias("lp2"),
    )
