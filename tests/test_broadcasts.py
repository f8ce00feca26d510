"""What joins broadcast: small sides as measured, never tables that only look small on disk."""

from pyspark.sql import functions as F

from cellgrove.operators.equalise import clahe
from cellgrove.session import cut


def cells(spark, rasters):
    rows = spark.range(rasters * 64).select(
        F.floor(F.col("id") / 64).alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"), (F.col("id") * 7919 % 256).cast("double").alias("v"),
    )
    return cut(rows)


def ran(df):
    """The plan as it ended."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_equalising_broadcasts_no_cells(spark):
    assert "BroadcastHashJoin" not in ran(clahe(cells(spark, 2000), "v", 4.0, (2, 2), "e"))


def test_few_measured_rows_are_broadcast(spark):
    df = cells(spark, 2000)
    few = df.groupBy((F.col("image_id") % 5).alias("image_id")).agg(F.max("v").alias("m"))
    assert "BroadcastHashJoin" in ran(df.join(few, "image_id"))
