"""Rasters of known size keep to the short plans: one branch of percentiles, no graph of tile components."""

from pyspark.sql import functions as F

from cellgrove.catalog.recipes import mosaic
from cellgrove.operators import components as P
from cellgrove.operators import masked as M
from cellgrove.operators.cells import nearest, to_cells


def small(spark):
    rows = spark.range(128).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.col("id") * 7 + i * 31) % 97).alias("embedding"))
    return to_cells(rows, "vec_id", "embedding", 8, 8).withColumn("fov", F.lit(True))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mosaics_and_resampled_rasters_have_one_branch_of_percentiles(spark):
    for df in (mosaic(small(spark)), nearest(small(spark), 64, 64)):
        scaled = M.normalise(df, "v", "fov", "n")
        assert "percentile_approx" not in plan(scaled) and "Union" not in plan(scaled)
        assert scaled.schema["h"].metadata == df.schema["h"].metadata


def test_mosaics_are_labelled_without_stored_steps(spark, back):
    df = mosaic(small(spark)).withColumn("m", F.col("v") > 40)
    short = P.label(df, "m")
    assert "parquet" not in plan(short)
    whole = P.label(df.withColumn("h", F.col("h") + 0), "m", tile=16)  # the bound is lost, and tiles are smaller
    assert (back(short, "comp") == back(whole, "comp")).all()
