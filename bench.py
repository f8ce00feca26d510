"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cellgrove.catalog import load  # noqa: E402
from cellgrove.session import local_session  # noqa: E402

HEADLINE = (
    "I9_fold_report",
    "I7_classification_report",
    "I3_pool_metrics",
    "I11_bias_sweep",
    "B2_exact_duplicates",
    "B3_ncc_pairs",
    "B6_stratified_kfold",
    "B7_stratified_group_kfold",
    "C2_grey",
    "D1_normalise_fallback",
    "D6_response_features",
    "D7_intensity_features",
    "E1_components_8",
    "E2_component_stats",
    "E12_thin",
    "F1_correlate_gaussian_reflect",
    "F2_matched_bank",
    "F3_erode_dilate",
    "F10_clahe",
    "F13_glcm",
    "G1_density_threshold",
    "G7_hysteresis_fixed",
    "H1_outward_direction",
    "J3_evaluate_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
