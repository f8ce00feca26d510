"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.session import work_dir

#: White space in the sense of all word rules here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null gives an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def keyed(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Only the columns an operator reads, so that no other column can clash with its own."""
    return df.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_{v}") for v in values])


def map_texts(docs: DataFrame, key: str, text: str, make: Callable[[], Callable[[list], list]], columns: str) -> DataFrame:
    """``key`` and what a function makes of the texts, as ``columns`` (a schema).

    ``make`` gives, once a task, a function from a list of texts (null: None) to one array for each
    column. The key column passes as Arrow holds it, so whole numbers beside nulls stay exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            made = [pa.array(a) for a in work(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names)

    names = [key, *[c.split()[0] for c in columns.split(",")]]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, {columns}")


def packed(df: DataFrame) -> Column:
    """The whole row as one column, to be unpacked with ``select("_row.*")``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def store(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, tightly compressed, and read back; see ``release``."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``store`` once all that is made of them is stored itself.

    Spark drops the shuffle files of finished steps when the driver collects its
    garbage, which a driver with much memory may not do for long; it is asked to.
    """
    for table in tables:
        spark = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()
