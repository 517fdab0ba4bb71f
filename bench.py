"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "monthly_bars",
    "ma_deviation",
    "asof_fundamental_join",
    "factor_panel",
    "winsor_zscore",
    "fmp_portfolio_sort",
    "xs_univariate_fmp",
    "spearman_ic",
    "xs_multivariate_betas",
    "expanding_trend_betas",
    "inject_hzz_fitted",
    "rolling_ic_weights",
    "run_ladder",
    "stop_take_grid",
    "cost_scenario_grid",
    "first_touch_exits",
    "mark_to_market",
    "benchmark_alpha_beta",
    "walk_forward",
    "monte_carlo",
    "block_bootstrap",
    "hansen_spa",
    "romano_wolf_stepm",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factorlab-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from factorlab.catalog import ENTRIES
    from factorlab.catalog.context import lab

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    # Building the shared tables is the pipeline's first half: time it as well.
    lb = lab(spark, sf_dir)
    timed("build_market_tables", lambda: (lb.tables, lb.index_tables))
    timed("build_panel", lambda: lb.panel)
    timed("build_curves", lambda: lb.curves)
    for name in HEADLINE:
        timed(name, lambda: ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
