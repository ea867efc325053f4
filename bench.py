"""Headline queries, timed. Prints one JSON line.

Each query runs twice and the second run counts: the first pays for class
loading and code generation, which a long-lived session pays once. ``--all``
times every registered query once, for finding slow plans.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyloom.plans.catalog import all_queries
from tallyloom.session import local_session

HEADLINE = [
    "flagship",
    "agg_session",
    "ses_build",
    "agg_channel",
    "src_sse_usage",
    "msg_overlap",
    "adv_top",
    "scan_rules",
    "scan_suppress",
    "doc_checks",
    "doc_normalise",
    "src_mdtable",
    "tsk_candidates",
    "tsk_dedup",
    "mod_assign",
    "est_days",
    "est_calib",
    "lvl_weeks",
    "tsk_merge",
    "jn_whitelist",
    "tsk_deduplong",
    "str_slide",
    "run_summary",
]


def timed(query, spark, sf_dir: str, runs: int) -> float:
    for _ in range(runs):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - start
    return round(seconds, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    registered = all_queries()
    everything = "--all" in sys.argv
    names = list(registered) if everything else HEADLINE
    seconds = {}
    for name in names:
        seconds[name] = timed(registered[name], spark, sf_dir, 1 if everything else 2)
        if everything:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
