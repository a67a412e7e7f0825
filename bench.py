"""Headline queries on one local Spark session; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS set the data and the cores. Shared stages
(bars, grid, panel, books, facts) are written once and timed as ``stage_*``, so a query's time is the
query alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pitspark.plans import registry
from pitspark.session import build_session
from pitspark.sources import bench as bv

STAGES = ["bars", "calendar", "bench_grid", "grid", "panel", "holdings", "book_changes", "raw_facts", "company_facts", "universe_history", "statements"]
QUERIES = [
    "a0_breakout_study", "f9_feature_bundle", "f11_f13_pit_technicals", "t1_asof_join", "t14_year_ago_filing", "l1_forward_returns", "l6_walk_barriers", "l7_walk_trailing_stop",
    "l9_geometry_grid", "l10_target_outcomes", "l13_build_trades", "x3_x4_company_table", "x6_x8_snapshots", "x10_sue_series",
    "x13_cheap_quality_screen", "h3_compare_quarters", "h4_select_positions", "h8_pit_universe", "h9_pit_broad_universe", "i1_insider_features", "e1_insider_cluster_events",
    "e2_earnings_surprise_events", "e2_trailing_percentile", "b5_random_picks", "g1_build_universe", "q1_cross_sectional_rank", "v1_per_date_metrics", "v3_evaluate_signals", "v19_pbo_cscv", "v22_concordance", "b1_bootstrap_ci",
    "b4_random_baseline", "p1_monthly_portfolio", "p9_calendar_time_portfolio", "r6_weighted_view", "r7_r12_rank_universe", "u5_compute_fundamentals", "d1_html_to_text", "d2_detect_sections",
    "d6_split_into_chunks", "d11_tfidf_fit", "d12_cosine_pairs", "d13_filing_features", "s1_bars_scan", "s4_insider_bulk_tsv", "s7_s8_information_tables", "a7_event_study",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k", "spark.sql.files.openCostInBytes": "262144"})
    spark.sparkContext.setLogLevel("ERROR")
    bv.table(spark, sf, "region").count()
    times: dict[str, float] = {}
    wanted = [w for w in os.environ.get("BENCH_ONLY", "").split(",") if w]
    for name in STAGES:
        t = time.perf_counter()
        getattr(bv, name)(spark, sf)
        times[f"stage_{name}"] = round(time.perf_counter() - t, 3)
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.perf_counter()
        run(registry.QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
