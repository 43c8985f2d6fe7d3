"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and executes the full plan through the ``noop`` sink
(every stage runs, nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans.registry import all_queries  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402

HEADLINE = [
    "J4_match_items",            # exact + fuzzy best match, every A row
    "J6_match_multi_name_brand",  # weighted multi-column match
    "J7_batch_targets",          # one reference against three targets
    "A2_describe_lineitem",      # moments + exact quantiles + modes over 8 columns
    "A7_outliers_lineitem",
    "Q3_null_runs_by_group",     # gaps-and-islands without a global window
    "Q10_type_validation",
    "B9_sales_growth_halves",
    "B16_monthly_trend",
    "B24_customer_value_summary",
    "H6_compare_tests",          # t / Mann-Whitney / KS with p-values
    "C2_union_fill_with_source",
    "J8_merge_on_key",
    "T3_trends_numeric",
    "F7_dependency_levels",      # iterative graph levels
    "G1_attribute_diff",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    qs = all_queries()
    # warm-up: JVM, Python workers and the parquet reader, not timed
    qs["A1_shape_lineitem"][0](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
