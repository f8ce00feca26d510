"""Registered queries against their SQL twins on the smallest tables.

A part runs by default; CELLGROVE_ALL=1 runs every pair.
"""

import os

import duckdb
import pytest

from cellgrove.catalog import load
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()
DEFAULT = """I1_confusion_counts I7_classification_report I9_fold_report I11_bias_sweep B1_assign_groups B2_exact_duplicates
B4_pair_components B7_stratified_group_kfold B10_ratio_split C6_residual_contrast C9_affine_resample D1_normalise_masked
D4_fill_nearest D5_active_percentile E2_component_stats E11_fov_mask F4_tophat F9_hessian_jerman F10_clahe F13_glcm G2_otsu
G3_triangle G7_hysteresis_density H3_aligned_fragments J4_shortlist A8_stream_ingest A9_parse_run_log""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("CELLGROVE_ALL") else DEFAULT)
def test_matches_sql(spark, con, name):
    verdict = compare(QUERIES[name](spark, SF), con.sql(SQL[name]))
    assert verdict.startswith("ok"), verdict


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
