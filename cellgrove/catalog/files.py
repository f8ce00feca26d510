"""Source, sink and stream queries (section A): files are first written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.curation import LANGS
from cellgrove.catalog.fixtures import CLASSES, OOF, oof, rounded
from cellgrove.operators.report import fold_report
from cellgrove.session import work_dir
from cellgrove.sources import files as S
from cellgrove.streaming.ingest import stream_ingest


def _folder(df):
    return f"{work_dir(df.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"


def _pointer_files(read):
    """One pointer file per language, standing for that language's documents."""
    docs = read("documents")
    text = F.concat_ws(
        "\n", F.lit(S.POINTER_HEAD), F.concat(F.lit("oid sha256:"), F.sha2(F.concat(F.col("lang"), F.col("n").cast("string")), 256)),
        F.concat(F.lit("size "), F.col("size")),
    )
    rows = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size")).select("lang", text.alias("value"))
    path = _folder(docs)
    rows.repartition("lang").write.partitionBy("lang").text(path)
    return docs.sparkSession, path


@query(
    "A1_scan_labelled",
    f"SELECT lang AS label, CAST(list_position([{', '.join(repr(c) for c in LANGS)}], lang) - 1 AS INTEGER) AS label_id, count(DISTINCT lang) AS n_files FROM documents GROUP BY lang",
)
def _(read):
    spark, path = _pointer_files(read)
    manifest = S.scan_labelled(spark, path, {f"lang={c}": c for c in LANGS}, LANGS, (".txt",))
    return manifest.groupBy("label", "label_id").agg(F.count("*").alias("n_files"))


@query(
    "A2_lfs_pointers",
    "SELECT true AS is_pointer, sha256(concat(lang, count(*))) AS oid, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY lang",
)
def _(read):
    spark, path = _pointer_files(read)
    return S.lfs_pointers(S.list_files(spark, path)).select("is_pointer", "oid", "size")


@query(
    "A3_read_group_map",
    """SELECT concat('img_', doc_id) AS key, CAST(quality * 2 + toxic AS BIGINT) AS "group" FROM labels WHERE doc_id % 5 <> 0""",
)
def _(read):
    labels = read("labels")
    rows = labels.select(
        F.concat(F.lit("a/img_"), F.col("doc_id"), F.lit(".jpg")).alias("name"),
        F.when(F.col("doc_id") % 5 != 0, F.col("quality") * 2 + F.col("toxic")).alias("group"),
    )
    path = _folder(labels)
    rows.write.json(path)
    return S.read_group_map(labels.sparkSession, path, multi_line=False)


@query(
    "A5_A6_csv_round_trip",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority = '1-URGENT' AS urgent, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders",
)
def _(read):
    orders = read("orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.round("o_totalprice", 2).alias("o_totalprice"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
    )
    path = _folder(orders)
    S.write_csv(orders, path, orders.columns)
    return S.read_csv_typed(orders.sparkSession, path, orders.schema)


@query("A8_stream_ingest", "SELECT event_id, event_type, value FROM events")
def _(read):
    events = read("events").select("event_id", "event_type", "value")
    spark, base = events.sparkSession, _folder(events)
    for part, rule in (("1", F.col("event_id") % 2 == 0), ("2", F.lit(True))):
        # the second delivery repeats every key of the first
        events.filter(rule).write.mode("append").parquet(f"{base}/in")
        stream_ingest(spark, f"{base}/in", events.schema, "event_id", f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "value")


@query(
    "A9_parse_run_log",
    f"""WITH {OOF}, per AS (
  SELECT fold, k.cls, count(*) FILTER (label_id = k.cls AND pred = k.cls) AS tp,
    count(*) FILTER (label_id = k.cls) AS support, count(*) FILTER (pred = k.cls) AS predicted
  FROM oof, (SELECT unnest(range(5)) AS cls) k GROUP BY fold, k.cls),
f AS (SELECT fold, round(avg(2.0 * tp / (support + predicted)) FILTER (support + predicted > 0), 4) AS f1,
  round(CAST(sum(tp) AS DOUBLE) / sum(support), 4) AS acc, CAST(sum(support) AS BIGINT) AS n FROM per GROUP BY fold)
SELECT 'fold' AS kind, CAST(fold AS VARCHAR) AS name, f1, NULL::DOUBLE AS accuracy, n FROM f
UNION ALL SELECT 'model', concat('m', fold), f1, acc, NULL FROM f
UNION ALL SELECT 'result', concat('run ', fold), f1, acc, NULL FROM f""",
)
def _(read):
    table = fold_report(oof(read), "fold", "label_id", "pred", CLASSES)
    f1, acc = F.format_string("%.4f", F.round("macro_f1", 4)), F.format_string("%.4f", F.round("accuracy", 4))
    fold = F.col("fold").cast("string")
    lines = table.select(
        F.explode(
            F.array(
                F.concat(F.lit("Fold "), fold, F.lit(": macro-F1="), f1, F.lit(" (n="), F.col("n").cast("string"), F.lit(")")),
                F.concat(F.lit("[m"), fold, F.lit("] macro-F1="), f1, F.lit("  acc="), acc),
                F.concat(F.lit('RESULT_JSON={"accuracy": '), acc, F.lit(', "f1": '), f1, F.lit(', "tag": "run '), fold, F.lit('"}')),
                F.lit("unrelated line"),
            )
        ).alias("value")
    )
    path = _folder(table)
    lines.write.text(path)
    return S.parse_run_log(table.sparkSession, path).select("kind", "name", "f1", "accuracy", "n")
