"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2, after one
warm-up; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "score_deal_rows", "rank_pipeline", "investment_engine", "opportunity_rules", "match_listings", "upsert_by_key",
    "two_miss_inactive", "snapshot_changes", "listing_history", "price_reductions", "price_history_array",
    "previous_prices", "comps_summary", "register_match", "enrichment_fanout", "enrichment_pivot",
    "candidates_with_listing", "listing_detail", "permits_union_dedupe", "infer_price_from_text", "keyword_flags",
    "html_listing_records", "portal_record", "stream_change_detection",
]


def main() -> None:
    from woonvonk.plans import catalog
    from woonvonk.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = catalog.jobs()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        if name not in jobs:
            continue
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:] or taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
