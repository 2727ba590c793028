"""Headline queries, timed once after a warm-up; prints one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallybook.catalog import REGISTRY
from tallybook.session import local_session

HEADLINE = (
    "achievements", "channel_stats", "account_info", "user_totals", "global_stats", "user_stats", "flair",
    "user_history", "channel_history", "linked_accounts", "resolve_users", "resolve_internal_address",
    "average_rates_hourly", "chained_rate", "rates_last_good", "value_actions", "wallet_solvency",
    "extract_commands", "build_action", "stage_actions", "read_commands", "triage_pending",
    "register_users", "merge_accounts", "upsert_actions", "reconcile_deposits", "confirm_withdrawals",
    "validate_actions", "settle_transfers", "settle_ledger", "buy_gold", "audit_postings",
    "notify", "select_messages", "render", "notify_account", "user_pages", "rates_by_window",
)


def run(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=cpus)
    run(spark, sf_dir, "achievements")  # start-up of the JVM and the file cache
    seconds = {name: round(run(spark, sf_dir, name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        ),
        flush=True,
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
