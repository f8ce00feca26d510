"""Row numbers and running sums that never put one group, or the table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellgrove.session import cut


def hash_key(id_col: str | Column, seed: int) -> Column:
    """A reproducible shuffle key: hex digest of id and seed, evenly spread."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", col.cast("string"), F.lit(str(seed))))


def bucketed_row_number(
    df: DataFrame,
    by: list[str],
    buckets: list[tuple[Column, bool]],
    order: list[Column],
    out: str = "rn",
    sum_of: Column | None = None,
    sum_out: str = "running",
) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` for hot groups.

    ``buckets`` are coarse, order-preserving prefixes of ``order`` as
    ``(expression, ascending)``. Rows are numbered inside (group, bucket); the
    bucket's offset comes from a table with one row per bucket. A group holding
    a third of all rows is thus spread over all its buckets. With ``sum_of`` an
    inclusive running sum is added the same way.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    tagged = df.withColumns({n: e for n, (e, _) in zip(names, buckets)})
    if sum_of is not None:
        tagged = tagged.withColumn("_s", sum_of)
    sizes = tagged.groupBy(*by, *names).agg(
        F.count("*").alias("_n"), *([F.sum("_s").alias("_t")] if sum_of is not None else [])
    )
    direction = [F.col(n).asc() if asc else F.col(n).desc() for n, (_, asc) in zip(names, buckets)]
    before = Window.partitionBy(*by).orderBy(*direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, *names])],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *([F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_toff")] if sum_of is not None else []),
    )
    inside = Window.partitionBy(*by, *names).orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(inside))
    if sum_of is not None:
        numbered = numbered.withColumn(
            "_rs", F.sum("_s").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
    match = [numbered[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate([*by, *names])]
    on = match[0]
    for m in match[1:]:
        on = on & m
    result = numbered.join(offsets, on).withColumn(out, F.col("_rn") + F.col("_off"))
    if sum_of is not None:
        result = result.withColumn(sum_out, F.col("_rs") + F.col("_toff"))
    return result.select(*df.columns, out, *([sum_out] if sum_of is not None else []))


def hash_row_number(df: DataFrame, by: list[str], id_col: str, seed: int, out: str = "rn") -> DataFrame:
    """Seeded random order inside each group, numbered from 1."""
    key = hash_key(id_col, seed)
    return bucketed_row_number(
        df, by, [(F.substring(key, 1, 3), True)], [key, F.col(id_col)], out
    )


def global_row_number(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """0-based position in the total order, as two passes over range partitions.

    The range-partitioned rows are written once, so both passes see the same
    partition boundaries; only per-partition counts are numbered in one place.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut(
        spread.withColumn("_pid", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        )
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_pid").agg(F.count("*").alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        stored.join(offsets, "_pid")
        .withColumn(out, F.col("_off") + F.col("_pos"))
        .select(*df.columns, out)
    )
