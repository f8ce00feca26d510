"""Files that keep arriving: the incremental build as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_ingest(
    spark: SparkSession,
    source: str,
    schema: StructType,
    key: str,
    target: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame] = lambda df: df,
    within: tuple[str, str] | None = None,
) -> None:
    """Build outputs for keys not seen before from every file now in ``source``.

    The query's checkpoint remembers files and keys, so a restart continues and
    a replayed batch overwrites its own folder only. Keys are kept for good, or,
    with ``within = (time column, delay)``, as long as late rows are expected.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    if within:
        rows = rows.withWatermark(*within).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
