"""Ranks of pairs whose scores are equal on paper."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cellgrove.catalog import load
from tools.check_oracles import compare


def test_pairs_of_equal_scores_rank_as_in_the_sql(spark, tmp_path):
    # four pairs of line ends face each other; the third and the fourth differ by rounding alone
    lines = {8, 9, 15, 22, 24, 25, 39, 46, 58, 59}
    rows = pa.table({"vec_id": [7], "embedding": [[float(k in lines) + k / 100 for k in range(64)]]})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    queries, sql = load()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in ("H2_pair_candidates_top", "H2_pair_candidates"):
        verdict = compare(queries[name](spark, str(tmp_path)), con.sql(sql[name]))
        assert verdict.startswith("ok"), (name, verdict)
