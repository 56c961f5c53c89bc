"""Headline queries on one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioforge.plans.catalog import QUERIES  # noqa: E402
from folioforge.session import build_session  # noqa: E402

HEADLINE = [
    "trade_totals", "pnl_by_symbol", "win_loss_stats", "cumulative_pnl", "trade_dedup", "duplicate_counts",
    "latest_positions", "holdings_consolidated", "reconcile_summary", "tech_ranking", "indicator_series",
    "beta_by_symbol", "option_adjusted_beta", "ttm_series", "splits", "ratio_history", "fundamental_score",
    "facts_to_metrics", "trade_ledger", "parsed_trades", "valuation_snapshot", "stored_statement_load",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(max(cpus, 4)), spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
