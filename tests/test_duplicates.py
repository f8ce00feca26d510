"""Every pair of rows, also of equal vectors and beside them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellgrove.catalog import load
from cellgrove.operators.duplicates import ncc_pairs
from tools.check_oracles import compare


@pytest.mark.parametrize(("cell_rows", "copy_rows"), [(3, 2), (1000, 1000)])
def test_copies_give_all_their_pairs(spark, cell_rows, copy_rows):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 12))
    # copies of one vector, of one near to it, and of one near to nothing
    beside = base[:10] + 0.05 * rng.normal(size=(10, 12))
    vectors = [*base, *beside, *[base[0]] * 7, *[beside[0]] * 4, *[base[20]] * 5]
    order = rng.permutation(len(vectors))
    df = spark.createDataFrame([(int(i), vectors[k].tolist()) for i, k in enumerate(order)], "id long, vec array<double>")
    rows = ncc_pairs(df, "id", "vec", 0.95, 12, cell_rows=cell_rows, star=False, copy_rows=copy_rows).collect()
    unit = np.array([(v - v.mean()) / np.linalg.norm(v - v.mean()) for v in vectors])[order]
    close = unit @ unit.T
    a, b = np.nonzero(np.triu(close >= 0.95, 1))
    assert sorted((r.a, r.b) for r in rows) == list(zip(a.tolist(), b.tolist()))
    assert all(r.ncc == pytest.approx(close[r.a, r.b], abs=1e-12) for r in rows)


def test_queries_over_copies_match_their_sql(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(120, 64)).astype(np.float32)
    vectors = np.concatenate([base, base[:30], base[:4]])
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": list(vectors)}), tmp_path / "embeddings.parquet")
    queries, sql = load()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in ("B3_ncc_pairs", "B4_pair_components"):
        verdict = compare(queries[name](spark, str(tmp_path)), con.sql(sql[name]))
        assert verdict.startswith("ok"), (name, verdict)
