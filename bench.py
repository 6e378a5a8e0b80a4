"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pitgrid import build_session
from pitgrid.plans import all_queries
from pitgrid.plans.registry import runnable, tables

HEADLINE = (
    "P01_latest_asof_facts", "P03_universe_asof", "P04_price_precedence", "P11_ticker_asof", "P13_membership_intervals",
    "F03_fundamental_ratios", "F05_estimate_change_asof", "F07_sector_neutral_zscore", "F12_beta_252d", "F15_factor_snapshot", "F19_percent_rank_avg",
    "T05_macd", "T12_verified_snapshot", "B06_rank_ic", "B08_factor_correlation", "B11_select_sector_quota", "B13_portfolio_risk",
    "R03_bearish_screen", "Q02_snapshot_coverage", "S03_merge_price_lake", "X03_strip_html", "X04_sentiment_counts", "I18_reject_future_effective",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus))
    t0 = time.perf_counter()
    t = tables(spark, sf_dir)
    # derive and stage the shared research tables first; timed on its own
    for name in ("signals", "prices", "prices_best", "fundamentals", "estimates", "instruments", "index_membership", "factor_panel", "labelled"):
        getattr(t, name)
    times = {"derive_tables": round(time.perf_counter() - t0, 3)}
    known = all_queries()
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            t1 = time.perf_counter()
            runnable(known[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t1)
        times[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
