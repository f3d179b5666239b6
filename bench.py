"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced end to end with the ``noop`` sink (full computation, no
collect to the driver). One warm-up pass, then the median of ``BENCH_REPS``
timed runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rimshot.plans import catalog  # noqa: E402
from rimshot.session import build_session  # noqa: E402

HEADLINE = [
    "f02_training_model",       # W1-W3 + W8 + F2: the flagship feature view
    "w01_rolling_features",     # W1-W3
    "w13_advanced_rolling",     # J1 + opponent join + 30 window frames
    "w16_core_availability",    # W16 player explode x10 + top-8 per team game
    "j09_matchup",              # J9 game-level differences
    "w12_elo_history",          # W12 per-season recurrence
    "m01_expected_wins",        # W17 M1: exact expected wins
    "q01_fold_metrics_game",    # Q1-Q4 metrics
    "j05_score_mismatch",       # J5 three-way join check
    "a01_pivot_games_bulk",     # A1 game-log pivot
    "s06_book_quotes",          # S6 JSON order books
    "j06_resolve_markets",      # J6 slug resolution
    "w11_time_split",           # W11 distributed row numbering
    "u03_guarded_upsert_map",   # U3 merge
    "a11_feature_audit",        # A11 exact distributed quantiles
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = catalog.queries()
    times = {}
    for name in names:
        fn = qs[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
