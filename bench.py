"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores; BENCH_QUERIES may name queries by
prefix, or be "all".
"""

from __future__ import annotations

import json
import os
import time

from tallystone.plans import catalogue
from tallystone.session import local_session

HEADLINE = [
    "f2_monthly_tree", "f4_month_coverage", "e4_month_over_month", "f6_spend_periods", "f7_merchant_drivers",
    "f30_review_groups", "e5_possible_duplicates", "f31_period_summary", "f9_recurring_charges",
    "c1_parse_amount", "c2_normalise_description", "c3_parse_date", "b5_detect_mapping", "c5_row_assembly",
    "a1_records_with_lines", "g1_occurrence", "e2_snapshot_resolution", "e3_incremental_resolution",
    "f16_fit_rules", "m4_hybrid_routing", "f10_system_scores", "f14_strata", "f17_threshold_sweep",
    "f19_failure_modes", "f24_usage", "j2_evaluation_subset", "k9_monthly_projection", "k10_comparison",
    "k12_negotiation_levers", "f26_grounding",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    names = HEADLINE
    if wanted:
        names = [n for n in catalogue.QUERIES if wanted == "all" or any(n.startswith(p) for p in wanted.split(","))]
    # the first job pays for starting executors and loading classes
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("/")[-1],
    }))


if __name__ == "__main__":
    main()
