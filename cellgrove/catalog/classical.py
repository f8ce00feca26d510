"""Model queries (section K). Fits are small here; the defaults are the full ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CELLS, CLASSES, SEED, cells, rounded
from cellgrove.operators import masked as M
from cellgrove.operators import models as K
from cellgrove.operators.folds import stratified_kfold


def vectors(read, k=5):
    rows = read("embeddings").select(
        F.col("vec_id").alias("key"),
        (F.col("label") % 5).cast("int").alias("label_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
    )
    return stratified_kfold(rows, "label_id", "key", k, SEED)


@query(
    "K1_assemble_features",
    f"""WITH {CELLS}, a AS (SELECT image_id, avg(v) AS m, stddev_pop(v) AS s FROM cells WHERE fov AND image_id % 7 <> 0 GROUP BY image_id)
SELECT vec_id AS image_id, label, round(coalesce(m, 0.0), 6) + 0.0 AS int_v_mean, round(coalesce(s, 0.0), 6) AS int_v_std FROM embeddings LEFT JOIN a ON image_id = vec_id""",
)
def _(read):
    manifest = read("embeddings").select(F.col("vec_id").alias("image_id"), "label")
    part = M.intensity_features(cells(read).filter("image_id % 7 <> 0"), ["image_id"], ["v"], F.col("fov"))
    return rounded(K.assemble_features(manifest, [part], "image_id"))


def _forest(read):
    return K.oof_predict(vectors(read), "features", "label_id", "fold", "key", K.random_forest(20, 5), CLASSES, 5)


def _boosting(read):
    return K.oof_predict(vectors(read, 3), "features", "label_id", "fold", "key", K.gradient_boosting(2, 3), CLASSES, 3)


def _kernel(read):
    wide = K.rff(vectors(read, 3), "features", 0.5, 128, 64, SEED, "z")
    return K.oof_predict(wide, "z", "label_id", "fold", "key", K.linear_svc(10), CLASSES, 3)


@query("K2_random_forest_oof")
def _(read):
    return _forest(read)


@query("K3_gradient_boosting_oof")
def _(read):
    return _boosting(read)


@query("K4_rbf_svc_oof")
def _(read):
    return _kernel(read)


@query("K5_compare_models")
def _(read):
    return rounded(K.compare_models({"forest": _forest(read), "kernel": _kernel(read)}, CLASSES))


@query("K5_top_importances")
def _(read):
    from pyspark.ml.functions import array_to_vector

    rows = vectors(read).select(array_to_vector("features").alias("x"), F.col("label_id").cast("double").alias("y"), F.lit(1.0).alias("weight"))
    model = K.random_forest(20, 5).fit(rows)
    return rounded(K.top_importances(rows.sparkSession, model, [f"f{i}" for i in range(64)]))
