"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.catalog import QUERIES, load_all  # noqa: E402
from barloom.plans.features import feature_table  # noqa: E402
from barloom.session import build_session  # noqa: E402
from barloom.sources import driver_tables as D  # noqa: E402
from barloom.sources.bars import daily_from_bars, with_day_session  # noqa: E402

HEADLINE = [
    "minimum_slice", "feature_table", "macd", "rsi_regime", "atr_pct", "vol_percentile", "support_resistance",
    "max_drawdown_30", "impulse_vector", "r_levels", "swing_candidates", "label_own_series", "bracket_exits",
    "one_position_at_a_time", "clean_features", "optimize_base", "impute_median", "winsorize", "clip_3sigma", "anova_f", "balanced_sample",
    "stratified_split", "auc_rank", "threshold_sweep", "bars_dedupe", "run_kpis", "run_trends", "last_n_per_key",
]


def timed(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def full_projection(spark, sf_dir: str) -> tuple[int, float]:
    """Bars and seconds of all features over five-minute bars in day sessions."""
    bars = with_day_session(D.event_bars(spark, sf_dir, 300))
    daily = daily_from_bars(bars)
    n = bars.count()
    began = time.perf_counter()
    timed(feature_table(bars, daily, day_sessions=True))
    return n, time.perf_counter() - began


def minute_projection(spark, sf_dir: str) -> tuple[int, float]:
    """Bars and seconds of all features over one-minute bars whose symbols grow with the table."""
    with D.minute_bars():
        bars = D.event_bars(spark, sf_dir)
        daily = daily_from_bars(bars)
        n = bars.count()
        began = time.perf_counter()
        timed(feature_table(bars, daily, day_sessions=True))
    return n, time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = build_session(
        "barloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": memory,
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    bars = D.event_bars(spark, sf_dir).count()  # also warms the session
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        timed(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - began, 3)
    fine_bars, fine_seconds = full_projection(spark, sf_dir)
    seconds["feature_table_5min"] = round(fine_seconds, 3)
    minute_bars, minute_seconds = minute_projection(spark, sf_dir)
    seconds["feature_table_minute"] = round(minute_seconds, 3)
    total = round(sum(seconds.values()), 3)
    rates = {Path(sf_dir).name: [minute_bars, round(minute_bars / minute_seconds, 1)]}
    small = Path(sf_dir).parent / "sf0.01"
    if small.is_dir() and small != Path(sf_dir):  # the same projection at another size, outside the total
        n, took = minute_projection(spark, str(small))
        rates[small.name] = [n, round(n / took, 1)]
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "driver_memory": memory, "bars": bars,
                "bars_5min": fine_bars, "full_projection_bars_per_sec": round(fine_bars / fine_seconds, 1),
                "minute_bars_and_bars_per_sec": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
