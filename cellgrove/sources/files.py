"""Sources and sinks: labelled folders, pointer files, group maps, CSV tables, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrove.functions.strings import key, parent, stem, suffix

# The first line of a pointer file.
POINTER_HEAD = "version https://git-lfs.github.com/spec/v1"
#: Pointer files are about 130 bytes; larger files are never opened to look.
POINTER_BYTES = 1024

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: path, modification time, length and content.

    Select what is needed: without ``content`` the files are only listed.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def scan_labelled(
    spark: SparkSession, root: str, dir2class: dict[str, str], classes: list[str], suffixes: tuple[str, ...] = IMAGE_SUFFIXES
) -> DataFrame:
    """Manifest of labelled folders: path, label, label_id, key."""
    path = F.col("path")
    lookup = F.create_map(*[F.lit(x) for pair in dir2class.items() for x in pair])
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    named = list_files(spark, root).select(
        "path", F.try_element_at(lookup, parent(path)).alias("label"), suffix(path).alias("_suffix")
    )
    return named.filter(F.col("label").isNotNull() & F.col("_suffix").isin(*suffixes)).select(
        "path", "label", ids[F.col("label")].alias("label_id"), key(F.col("label"), path).alias("key")
    )


def lfs_pointers(files: DataFrame) -> DataFrame:
    """Which files are pointers, with the digest and size they stand for.

    Only small files are read; the length filter reaches the file listing.
    """
    text = F.decode(F.col("content"), "UTF-8")
    small = files.filter(F.col("length") < POINTER_BYTES).select("path", text.alias("_t"))
    is_pointer = F.startswith("_t", F.lit(POINTER_HEAD))
    found = small.select(
        "path",
        is_pointer.alias("is_pointer"),
        F.when(is_pointer, F.regexp_extract("_t", r"oid sha256:([0-9a-f]{64})", 1)).alias("oid"),
        F.when(is_pointer, F.regexp_extract("_t", r"size (\d+)", 1).cast("long")).alias("size"),
    )
    large = files.filter(F.col("length") >= POINTER_BYTES).select(
        "path", F.lit(False).alias("is_pointer"), F.lit(None).cast("string").alias("oid"), F.lit(None).cast("long").alias("size")
    )
    return found.unionByName(large)


def quarantine(manifest: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a manifest into usable files and pointers."""
    bad = pointers.filter("is_pointer").select("path")
    return manifest.join(bad, "path", "left_anti"), manifest.join(bad, "path", "left_semi")


def read_group_map(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``key, group`` from a JSON list of objects; objects lacking either field are skipped."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("group", T.LongType())])
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return rows.filter("name is not null and `group` is not null").select(stem(F.col("name")).alias("key"), "group")


def write_csv(df: DataFrame, path: str, cols: list[str]) -> None:
    """Write columns in the given order with a header; NULL becomes an empty field."""
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.nullif(F.trim(F.col(name)), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(text.isNotNull(), F.lower(text).isin("1", "true", "yes"))
    if isinstance(kind, T.StringType):
        return text
    return text.try_cast(kind)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a stored table with lenient types: yes-words are true, empty is NULL."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = spark.read.schema(raw).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[_typed(f.name, f.dataType).alias(f.name) for f in schema.fields])


_RESULT = "accuracy double, f1 double, precision double, recall double, tag string"


def parse_run_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Figures out of run logs, one row per recognised line.

    ``kind`` is fold, result, class or model. Lines are taken one by one: their
    order in a log is not reliable and is not used.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    line = F.col("line")
    grab = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    fold = r"^Fold (\d+): macro-F1=([0-9.]+)(?: \(n=(\d+)\))?"
    model = r"^\[([^\]]+)\]\s+macro-F1=([0-9.]+)\s+acc=([0-9.]+)"
    cls = r"^(\S+)\s+([01]\.\d+)\s+([01]\.\d+)\s+([01]\.\d+)\s+(\d+)$"
    payload = F.from_json(grab(r"^RESULT(?:_JSON)?=(\{.*\})", 1), _RESULT)
    parsed = lines.withColumns(
        {
            "kind": F.when(line.rlike(fold), "fold")
            .when(line.rlike(r"^RESULT(_JSON)?=\{"), "result")
            .when(line.rlike(model), "model")
            .when(line.rlike(cls), "class"),
            "p": payload,
        }
    ).filter(F.col("kind").isNotNull())
    kind = F.col("kind")
    return parsed.select(
        "file",
        "kind",
        F.when(kind == "fold", grab(fold, 1)).when(kind == "model", grab(model, 1)).when(kind == "class", grab(cls, 1))
        .otherwise(F.col("p.tag")).alias("name"),
        F.when(kind == "fold", grab(fold, 2)).when(kind == "model", grab(model, 2)).when(kind == "class", grab(cls, 4))
        .cast("double").alias("_f1"),
        F.when(kind == "model", grab(model, 3)).cast("double").alias("_acc"),
        F.when(kind == "class", grab(cls, 2)).cast("double").alias("_precision"),
        F.when(kind == "class", grab(cls, 3)).cast("double").alias("_recall"),
        F.when(kind == "fold", grab(fold, 3)).when(kind == "class", grab(cls, 5)).cast("long").alias("n"),
        "p",
    ).select(
        "file",
        "kind",
        "name",
        F.coalesce("_f1", "p.f1").alias("f1"),
        F.coalesce("_acc", "p.accuracy").alias("accuracy"),
        F.coalesce("_precision", "p.precision").alias("precision"),
        F.coalesce("_recall", "p.recall").alias("recall"),
        "n",
    )
