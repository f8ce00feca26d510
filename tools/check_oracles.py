"""Run registered queries against their SQL twins: check_oracles.py [sf_dir] [name-prefix ...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from cellgrove.catalog import load  # noqa: E402
from cellgrove.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None if v is None else "nan"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(df, rel):
    left = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    right = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if sorted(left) != sorted(right):
        return f"columns {sorted(left)} vs {sorted(right)}"
    cols = sorted(left)
    a = sorted((repr([norm(r[c]) for c in cols]) for r in df.collect()))
    idx = [rel.columns.index(c) for c in cols]
    b = sorted((repr([norm(r[i]) for i in idx]) for r in rel.fetchall()))
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} differ, e.g. {bad[0][0][:300]} | {bad[0][1][:300]}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}:{left[c]}/{right[c]}" for c in cols if same.get(left[c], right[c]) != right[c]]
    return ("types " + ", ".join(odd)) if odd else f"ok rows={len(a)}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries, sql = load()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                verdict = compare(df, con.sql(sql[name]))
            else:
                verdict = f"ok rows={df.count()} (no sql)"
        except Exception as err:  # report and go on
            verdict = "error " + str(err).strip()[:600].replace("\n", " ")
        failed += not verdict.startswith("ok")
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
