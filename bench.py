"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "G1_H1_I1_breakout_by_year",
    "C1_lit_trades",
    "C5_time_bars",
    "C10_volume_bars",
    "C12_imbalance_bars",
    "C20_checkpoint_snapshots",
    "D2_asof_forward_strict",
    "D4_asof_backward_strict_hot_key",
    "D9_windowed_sums_from_prefix",
    "E5_total_return_adjustment",
    "E7_intraday_candidates",
    "E10_heat",
    "F7_ema_long_series",
    "F12_F14_F16_tightness_channels",
    "F20_runs_below_vwap",
    "G6_vwap_reclaim",
    "G13_armed_breakout_rolling_rearm",
    "H4_stop_atr_ratchet",
    "H7_frozen_level_stop",
    "I5_equal_count_deciles",
    "I7_floor_sweep",
    "I18_monthly_mark_to_market",
    "J4_consolidated_levels",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1)))
    only = sys.argv[1:] or HEADLINE
    from barspark.plans import load
    from barspark.session import get_spark

    spark = get_spark("bench", cores)
    queries = load()[0]
    # the engine starts before the clock: one small query warms up the session
    queries["B3_date_range"](spark, sf).collect()
    times = {}
    for name in only:
        t0 = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": cores}))


if __name__ == "__main__":
    main()
