"""Tasks that make cells hold no more of them when the source grows."""

from pyspark.sql import functions as F

from cellgrove.operators.cells import TASK_CELLS, to_cells


def test_tasks_of_cells_are_bounded(spark):
    df = spark.range(20_000).coalesce(8).select("id", F.array_repeat(F.lit(1.0), 64).alias("a"))
    made = to_cells(df, "id", "a", 8, 8).groupBy(F.spark_partition_id().alias("p")).count()
    assert made.agg(F.max("count")).first()[0] <= 1.25 * TASK_CELLS
    assert made.agg(F.sum("count")).first()[0] == 20_000 * 64
