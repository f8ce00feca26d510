"""Session helpers: a local session for tests, and the lineage cut used by loops."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest measured side of a join that is broadcast; a query has dozens of such joins.
BROADCAST = "2m"
#: Aim for the shuffled bytes of a task: cells take a few bytes there and a few hundred where they are sorted.
PARTITION = "8m"


def local_session(cpus: int | str = "*", app: str = "cellgrove") -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own."""
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> None:
    """Session settings this library relies on; all can be changed at run time.

    Stencil and histogram stages do far more work per byte than a scan, so
    merging shuffle partitions up to the usual size would leave cores idle.
    Partitions may be this small only while there are fewer of them than cores.

    Skewed joins must be split even at the price of another shuffle: a stencil
    after a join on the image could otherwise keep the join's partitioning and
    with it one huge raster in one task.

    Joins broadcast only what a finished shuffle measured as small. Estimates come
    from file sizes, and a written cell table takes about a byte a row on disk: a
    whole table, exploded four times over, could pass for a small side and go
    through the driver.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Spread a source with fewer splits than cores by key; larger ones are left alone.

    With ``rows`` there are also so many partitions that each holds about that many
    rows, however large the source, for sources whose rows grow to many in a task.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = os.path.join(tempfile.gettempdir(), f"cellgrove-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Loops grow their plan every round, and a table that feeds both an aggregate
    and the join back to it would be computed twice. A written table ends both:
    it survives lost executors and keeps column pruning. Its size on disk says little
    about its rows (see ``tune``).
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.__dict__["stored"] = True
    return stored


def shared(df: DataFrame) -> DataFrame:
    """``df`` as a written table, for steps that read it several times."""
    return df if df.__dict__.get("stored") else cut(df)
