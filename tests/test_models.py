"""Fits take as many partitions as their rows need."""

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.sql import functions as F

from cellgrove.operators import models as K


class Watched(OneVsRest):
    """Notes the partitions it is fitted on, and their rows."""

    seen = []

    def _fit(self, dataset):
        self.seen.append((dataset.rdd.getNumPartitions(), dataset.groupBy("y").agg(F.first("weight"), F.count("*")).collect()))
        return super()._fit(dataset)


def test_partitions_of_a_fit_do_not_go_with_the_source(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "2k")
    try:
        rows = spark.range(3000).repartition(60).select(
            F.col("id").alias("key"), F.pmod("id", F.lit(2)).cast("int").alias("fold"), F.when(F.col("id") % 5 == 0, 1).otherwise(0).alias("label"),
            F.array(F.when(F.col("id") % 5 == 0, 1.0).otherwise(-1.0), F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("f"),
        )
        one = LinearSVC(featuresCol="x", labelCol="y", weightCol="weight", maxIter=3)
        Watched.seen.clear()
        out = K.oof_predict(rows, "f", "label", "fold", "key", Watched(classifier=one, featuresCol="x", labelCol="y", weightCol="weight"), [0, 1], 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(out) == 3000 and all(r.pred == r.label_id for r in out)
    for parts, weights in Watched.seen:
        assert parts <= spark.sparkContext.defaultParallelism
        assert {int(y): (round(w, 3), n) for y, w, n in weights} == {0: (0.625, 1200), 1: (2.5, 300)}
