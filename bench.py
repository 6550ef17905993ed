"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 for every registered query, BENCH_ONLY=part,part to choose by name.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = """
s02_read_jsonl_strict s06_write_snapshot p05_normalize_text p10_strict_filter p12_record_flags p15_neg_log10_molar
p24_largest_component p25_identity_key t01_keyword_matrix t03_extract_field t05_multi_label t09_clause_then_numbers
j03_outer_with_indicator j06_constrained_self_join j10_star_join j13_distinct_over_members a01_entity_aggregate
a02_source_aggregate a05_long_value_counts a08_flag_coverage a09_signature_families a10_pair_medians w03_keep_one
w04_average_rank w05_cumulative_share q03_unique_key q10_no_leakage d02_delta_values d03_delta_report d06_clean_negatives
c01_paired_contrasts c05_signed_rank c07_bootstrap_median m01_regression_metrics m02_spearman m03_roc_auc m07_fold_summary
k01_group_kfold k03_stratified_split f01_fingerprint f02_descriptors l01_mean_baseline l11_feature_associations
l12_partial_correlation
""".split()


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from mensura.plans import catalog  # noqa: F401
    from mensura.plans.registry import QUERIES
    from mensura.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_ONLY"):
        names = [n for n in QUERIES if any(p in n for p in os.environ["BENCH_ONLY"].split(","))]
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start-up is not timed
    seconds, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error)[:200]
        print(name, seconds.get(name, "FAILED"), file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    line = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus),
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
