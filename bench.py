"""Benchmark: warm wall time per headline query, one JSON line on stdout.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query, median taken (default 2)
BENCH_ALL      1 = every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from aislemetrics.session import local_session
from workload import QUERIES

HEADLINE = (
    "missing_summary duplicate_rows numeric_summary sigma_outliers box_stats "
    "department_analysis strategic_class vendor_profitability "
    "business_overview store_performance abc_classes xyz_classes abc_xyz_matrix weekly_performance growth_analysis "
    "growth_by_store efficiency_quartiles inventory_turnover service_level lifecycle_stage sales_report "
    "province_stats weekly_price_stats pricing_strategy price_consistency_by_item category_analysis pricing_report "
    "by_banner region_brand panel_variance response_timing competitive_report "
    "price_trend_by_store rolling_mean_by_store peaks_troughs_by_store lead_lag_corr_by_store "
    "anova_price_by_region ttest_gap_by_promotion normality_test correlation_matrix "
    "store_correlations_shared_weeks influence_scores price_coordination store_clusters_by_sales "
    "gap_item_volume_levels gap_own_modal_prices gap_market_pivot gap_attach_prices gap_display_range "
    "stream_hourly_totals"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), memory="16g", scratch=tempfile.mkdtemp(prefix="bench-"))

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("weekly_performance")
    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total warm time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
