"""Classical models on feature tables, predicted out of fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators.folds import class_weights
from cellgrove.operators.report import averages, pair_counts, per_class
from cellgrove.session import cut

#: Training rows of a partition, about; there are no fewer partitions than cores.
TRAIN_ROWS = 1 << 16


def assemble_features(manifest: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Join feature tables to the manifest; rows a part failed on become zeros."""
    out = manifest
    for part in parts:
        out = out.join(part, key, "left")
    numeric = [f.name for f in out.schema.fields if f.name not in manifest.columns and f.dataType.simpleString() in ("double", "float")]
    finite = {c: F.when(F.isnan(c), 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in numeric}
    return out.withColumns(finite)


def feature_array(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def random_forest(trees: int = 400, depth: int = 30, seed: int = 42) -> Estimator:
    """Forest with balanced weights; Spark's largest depth is 30."""
    return RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )


def gradient_boosting(rounds: int = 300, depth: int = 3, rate: float = 0.05, seed: int = 42) -> Estimator:
    """Boosting is binary in Spark, so one ensemble per class."""
    one = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return OneVsRest(classifier=one, featuresCol="x", labelCol="y", parallelism=4)


def linear_svc(iterations: int = 100, regularisation: float = 0.01) -> Estimator:
    """Over random Fourier features this approximates an RBF support-vector classifier."""
    one = LinearSVC(featuresCol="x", labelCol="y", weightCol="weight", maxIter=iterations, regParam=regularisation)
    return OneVsRest(classifier=one, featuresCol="x", labelCol="y", weightCol="weight", parallelism=4)


def rff(df: DataFrame, features: str, gamma: float, width: int, length: int, seed: int, out: str) -> DataFrame:
    """Random Fourier features of exp(-gamma * distance^2): sqrt(2/D) cos(w.x + b)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (length, width))
    b = rng.uniform(0.0, 2.0 * np.pi, width)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / width) * np.cos(np.stack(x.to_numpy()) @ w + b)
        return pd.Series(list(z))

    return df.withColumn(out, project(features))


def oof_predict(
    df: DataFrame, features: str, label: str, fold: str, key: str, est: Estimator, classes: list[int], k: int, scale: bool = True
) -> DataFrame:
    """Fit once per fold on the other folds and predict it; one row per key.

    Class weights come from the training rows alone. Fits are distributed; the
    fold loop and one weight a class are the only things on the driver. Every step of
    a fit sends a result for each partition, so their number goes with the rows
    and not with how the source was split.
    """
    rows = cut(df.select(key, fold, F.col(label).cast("double").alias("y"), array_to_vector(features).alias("raw")))
    stages = [StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)] if scale else []
    parts, spread = [], max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TRAIN_ROWS))
    for i in range(k):
        train = rows.filter(F.col(fold) != i)
        weights = class_weights(train.withColumn("c", F.col("y").cast("int")), "c", classes).select("cls", "weight").collect()
        weight = F.coalesce(*[F.when(F.col("y") == float(c), F.lit(w)) for c, w in weights])
        weighted = train.withColumn("weight", weight).filter("weight is not null")
        weighted = weighted.repartition(spread, key).sortWithinPartitions(key)  # bags go by partition and row
        test = rows.filter(F.col(fold) == i)
        if not scale:
            weighted, test = weighted.withColumnRenamed("raw", "x"), test.withColumnRenamed("raw", "x")
        model = Pipeline(stages=[*stages, est]).fit(weighted)
        parts.append(
            model.transform(test).select(
                key, fold, F.col("y").cast("int").alias("label_id"), F.col("prediction").cast("int").alias("pred")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_models(predictions: dict[str, DataFrame], classes: list[int]) -> DataFrame:
    """Macro-F1 and accuracy of several out-of-fold tables."""
    stacked = None
    for name, df in predictions.items():
        part = df.select(F.lit(name).alias("model"), "label_id", "pred")
        stacked = part if stacked is None else stacked.unionByName(part)
    per = per_class(pair_counts(stacked, "label_id", "pred", ["model"]), classes, ["model"])
    return averages(per, ["model"]).select("model", "macro_f1", "accuracy", "n")


def top_importances(spark, model, names: list[str], n: int = 12) -> DataFrame:
    """The n most important features of a fitted forest."""
    rows = list(zip(names, [float(v) for v in model.featureImportances.toArray()]))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)
