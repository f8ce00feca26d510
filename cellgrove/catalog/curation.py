"""Curation queries (sections A and B) over the document, order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrove.catalog import query
from cellgrove.catalog.fixtures import CLASSES, SEED, oof, OOF, rounded
from cellgrove.operators import curate as C
from cellgrove.operators import duplicates as D
from cellgrove.operators import folds as S

LANGS = ["en", "fr", "de", "es"]
EVENTS = ["click", "view", "purchase", "signup", "error"]


def docs(read):
    return read("documents").select("doc_id", "lang", "source", "n_chars")


RANKED = f"""ranked AS (SELECT doc_id, lang, source,
  row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':{SEED}')), doc_id) AS rn,
  count(*) OVER (PARTITION BY lang) AS n FROM documents)"""


@query(
    "B1_assign_groups",
    """WITH gm AS (SELECT doc_id, quality * 2 + toxic AS g FROM labels)
SELECT d.doc_id, CAST(coalesce(g, (SELECT max(g) + 1 FROM gm) + row_number() OVER (ORDER BY d.doc_id) - 1) AS BIGINT) AS "group",
  CASE WHEN g IS NULL THEN 'singleton' ELSE 'group_map' END AS group_source
FROM documents d LEFT JOIN gm USING (doc_id)""",
)
def _(read):
    gmap = read("labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("group"))
    return C.assign_groups(read("documents").select("doc_id"), gmap, "doc_id", ["doc_id"])


@query(
    "B2_exact_duplicates",
    """SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) > 1 AS label_conflict
FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(read):
    return D.exact_duplicates(read("documents"), "doc_id", "text", "source")


@query(
    "B2_duplicate_members",
    """WITH g AS (SELECT text, min(doc_id) AS first_id, count(DISTINCT source) > 1 AS label_conflict
  FROM documents GROUP BY text HAVING count(*) > 1)
SELECT doc_id, first_id, label_conflict FROM documents JOIN g USING (text)""",
)
def _(read):
    members = D.duplicate_members(read("documents").select("doc_id", "text", "source"), "doc_id", "text", "source")
    return members.select("doc_id", "first_id", "label_conflict")


NCC = """unit AS (SELECT vec_id AS id, list_transform(c, lambda q: q / sqrt(list_sum(list_transform(c, lambda r: r * r)))) AS u
  FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda q: q - list_avg(CAST(embedding AS DOUBLE[]))) AS c
  FROM embeddings)),
pairs AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS ncc FROM unit a JOIN unit b ON a.id < b.id
  WHERE list_dot_product(a.u, b.u) >= {t})"""


@query("B3_ncc_pairs", f"WITH {NCC.format(t=0.40)} SELECT a, b, round(ncc, 6) AS ncc FROM pairs")
def _(read):
    return rounded(D.ncc_pairs(read("embeddings"), "vec_id", "embedding", 0.40, 64, star=False))


@query(
    "B4_pair_components",
    f"""WITH RECURSIVE {NCC.format(t=0.40)}, links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS root FROM links UNION SELECT e.b, r.root FROM reach r JOIN links e ON e.a = r.id WHERE r.root < e.b)
SELECT id, min(root) AS "group" FROM reach GROUP BY id""",
)
def _(read):
    return D.pair_components(D.ncc_pairs(read("embeddings"), "vec_id", "embedding", 0.40, 64))


@query(
    "B5_leak_report",
    f"""WITH {RANKED} SELECT source, count(DISTINCT (rn - 1) % 5) AS n_folds, count(*) AS n_rows FROM ranked
GROUP BY source HAVING count(DISTINCT (rn - 1) % 5) > 1""",
)
def _(read):
    return S.leak_report(S.stratified_kfold(docs(read), "lang", "doc_id", 5, SEED), "source", "fold")


@query("B6_stratified_kfold", f"WITH {RANKED} SELECT doc_id, lang, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked")
def _(read):
    return S.stratified_kfold(docs(read), "lang", "doc_id", 5, SEED).select("doc_id", "lang", "fold")


@query(
    "B7_stratified_group_kfold",
    f"""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS size, arg_max(o_orderpriority, (n, o_orderpriority)) AS dom FROM c GROUP BY o_custkey),
r AS (SELECT o_custkey, (row_number() OVER (PARTITION BY dom ORDER BY size DESC, md5(concat(o_custkey, ':{SEED}'))) - 1) % 10 AS turn FROM g)
SELECT o_orderkey, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM orders JOIN r USING (o_custkey)""",
)
def _(read):
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    dealt = S.stratified_group_kfold(orders, "o_orderpriority", "o_custkey", 5, SEED)
    return dealt.select("o_orderkey", "fold")


@query(
    "B7_group_kfold_documents",
    f"""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
g AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, arg_max(lang, (n, lang)) AS dom FROM c GROUP BY source),
r AS (SELECT source, (row_number() OVER (PARTITION BY dom ORDER BY size DESC, md5(concat(source, ':{SEED}'))) - 1) % 10 AS turn FROM g)
SELECT doc_id, lang, source, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold FROM documents JOIN r USING (source)""",
)
def _(read):
    dealt = S.stratified_group_kfold(docs(read), "lang", "source", 5, SEED)
    return dealt.select("doc_id", "lang", "source", "fold")


@query("B7_group_kfold_vectors")
def _(read):
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return S.group_kfold_by_vectors(orders, "o_orderpriority", "o_custkey", 5, SEED)


@query(
    "B8_fold_crosstab",
    f"""WITH {RANKED} SELECT CAST((rn - 1) % 5 AS INTEGER) AS fold, {', '.join(f"count(*) FILTER (lang = '{c}') AS {c}" for c in LANGS)}
FROM ranked GROUP BY 1""",
)
def _(read):
    return S.fold_crosstab(S.stratified_kfold(docs(read), "lang", "doc_id", 5, SEED), "fold", "lang", LANGS)


@query(
    "B9_stratified_split",
    f"""WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(c_custkey, ':{SEED}')), c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rn <= round_even(n * 0.4, 0) THEN 'test' ELSE 'train' END AS split FROM r""",
)
def _(read):
    customers = read("customer").select("c_custkey", "c_mktsegment")
    return S.stratified_split(customers, ["c_mktsegment"], "c_custkey", 0.4, SEED)


@query(
    "B10_ratio_split",
    f"""WITH {RANKED} SELECT doc_id, lang, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.9, 0) THEN 'valid' ELSE 'test' END AS split FROM ranked""",
)
def _(read):
    return S.ratio_split(read("documents").select("doc_id", "lang"), ["lang"], "doc_id", (8, 1, 1), SEED)


@query(
    "B11_class_counts",
    f"""WITH k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate([*EVENTS, 'absent']))}) t(position, cls))
SELECT CAST(position AS INTEGER) AS position, cls, count(event_id) AS n FROM k LEFT JOIN events ON event_type = cls GROUP BY ALL""",
)
def _(read):
    return S.class_counts(read("events"), "event_type", [*EVENTS, "absent"])


@query(
    "B12_sample_per_class",
    f"WITH {RANKED} SELECT doc_id, lang, lang AS wanted, CAST(rn AS INTEGER) AS rn FROM ranked WHERE rn <= 7",
)
def _(read):
    return S.sample_per_class(read("documents").select("doc_id", "lang"), "lang", "doc_id", 7, SEED)


@query(
    "B12_sample_with_fallback",
    f"""WITH {RANKED}, own AS (SELECT doc_id, lang, rn FROM ranked WHERE rn <= 3),
anyone AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat(doc_id, ':{SEED}')), doc_id) AS rn FROM documents)
SELECT doc_id, lang, CAST(rn AS INTEGER) AS rn, lang AS wanted FROM own WHERE lang IN ('de', 'en')
UNION ALL SELECT doc_id, lang, CAST(rn AS INTEGER), 'nl' FROM own WHERE lang = 'de'
UNION ALL SELECT doc_id, lang, CAST(rn AS INTEGER), 'xx' FROM anyone WHERE rn <= 3""",
)
def _(read):
    return S.sample_per_class(
        read("documents").select("doc_id", "lang"), "lang", "doc_id", 3, SEED, ["de", "en", "nl", "xx"], {"nl": "de"}
    )


@query(
    "B13_head_per_group",
    """SELECT o_orderkey, o_orderstatus, CAST(rn AS INTEGER) AS rn FROM (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 5""",
)
def _(read):
    orders = read("orders").select("o_orderkey", "o_orderstatus")
    return S.head_per_group(orders, ["o_orderstatus"], [F.col("o_orderkey")], 5)


@query(
    "B14_round_robin",
    """SELECT event_id, event_type, CAST(rn AS INTEGER) AS rn FROM (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 23""",
)
def _(read):
    return S.round_robin(read("events").select("event_id", "event_type"), "event_type", [F.col("event_id")], 23)


@query("B15_weighted_sample")
def _(read):
    weight = F.when(F.col("label") % 5 == 1, 3.0).otherwise(1.0)
    return S.weighted_sample(read("embeddings"), "vec_id", weight, SEED)


@query(
    "B16_filter_classes",
    "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label_id FROM documents WHERE lang IN ('en', 'de', 'es')",
)
def _(read):
    return S.filter_classes(read("documents").select("doc_id", "lang"), "lang", ["en", "de", "es"])


@query(
    "B17_class_weights_balanced",
    f"""WITH {OOF} SELECT label_id AS cls, count(*) AS n,
  round((SELECT count(*) FROM oof) / (5.0 * count(*)), 6) AS weight FROM oof GROUP BY label_id""",
)
def _(read):
    return rounded(S.class_weights(oof(read), "label_id", CLASSES))


@query(
    "B17_class_weights_capped",
    f"""WITH {OOF}, w AS (SELECT label_id AS cls, count(*) AS n,
  least(sqrt((SELECT count(*) FROM oof) / (5.0 * count(*))), 4.0) AS w FROM oof GROUP BY label_id)
SELECT cls, n, round(w / avg(w) OVER (), 6) AS weight FROM w""",
)
def _(read):
    return rounded(S.class_weights(oof(read), "label_id", CLASSES, "capped"))


@query(
    "A4_pair_files",
    """SELECT 'all' AS source, CAST(doc_id AS VARCHAR) AS name, concat('/images/', doc_id, '.jpg') AS image_path,
  concat('/masks/', doc_id, '.png') AS mask_path, doc_id AS stem_number FROM documents JOIN labels USING (doc_id)""",
)
def _(read):
    listing = lambda df, folder, ext: df.select(
        F.lit("all").alias("source"), F.concat(F.lit(f"/{folder}/"), F.col("doc_id"), F.lit(ext)).alias("path")
    )
    return C.pair_files(listing(read("documents"), "images", ".jpg"), listing(read("labels"), "masks", ".png"))


@query(
    "A4_pair_files_fallback",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '/masks/' WHEN doc_id % 2 = 0 THEN '/Masks/' ELSE '/mask/' END AS folder FROM labels)
SELECT source, concat(doc_id, '.png') AS name, concat('/images/', doc_id, '.png') AS image_path, concat(folder, doc_id, '.png') AS mask_path,
  CAST(NULL AS BIGINT) AS stem_number FROM documents JOIN m USING (doc_id)""",
)
def _(read):
    # masks by full name, from the first spelling of the folder that has one
    name = F.concat(F.col("doc_id"), F.lit(".png"))
    rows = read("labels").join(read("documents").select("doc_id", "source"), "doc_id")
    found = lambda folder, where: rows.filter(where).select(
        "source", name.alias("file"), F.concat(F.lit(folder), name).alias("path")
    )
    spellings = [found("/masks/", "doc_id % 3 <> 0"), found("/Masks/", "doc_id % 2 = 0"), found("/mask/", "true")]
    masks = C.prefer_first(spellings, ["source", "file"])
    images = read("documents").select("source", F.concat(F.lit("/images/"), name).alias("path"))
    return C.pair_files(images, masks, "name")


@query(
    "A7_incremental_build",
    "SELECT doc_id, upper(lang) AS built FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(read):
    build = lambda m: m.select("doc_id", F.upper("lang").alias("built"))
    return C.incremental_build(read("documents").select("doc_id", "lang"), read("labels"), "doc_id", build)[0]


@query(
    "A7_build_status",
    """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cached' ELSE 'built' END AS status, count(*) AS n
FROM documents GROUP BY 1""",
)
def _(read):
    return C.incremental_build(read("documents").select("doc_id"), read("labels"), "doc_id", lambda m: m)[1]


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "A10_encode_label",
    f"""SELECT o_orderkey, CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES))} END AS label_id,
  o_orderpriority AS label FROM orders WHERE o_orderpriority IN ({', '.join(f"'{p}'" for p in PRIORITIES)})
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderpriority NOT IN ({', '.join(f"'{p}'" for p in PRIORITIES)})""",
)
def _(read):
    coded = S.encode_label(read("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", PRIORITIES)
    return S.decode_label(coded, "label_id", PRIORITIES).select("o_orderkey", "label_id", "label")
