"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1
timed runs after one warm-up; the smallest time counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "top_companies", "facets", "province_rollup", "company_profile", "sector_rollup", "skill_trends",
    "level_counts", "run_summary", "search_page", "search_totals", "match_score",
    "resolve_duplicates", "resolve_incremental", "sync_report_full",
    "upsert_merge", "last_per_key", "first_visit", "explode_api_payload", "extract_embedded_json",
    "html_to_text", "section_text", "extract_links", "label_value_fields", "normalize_text",
    "role_level_split", "geo_enrich", "tracker_state", "stream_ingest", "stream_tracker", "overview_document",
]


def main() -> None:
    from jobloom.plans import catalog
    from jobloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    queries, _ = catalog.load()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        first = once(name)
        times[name] = round(min([once(name) for _ in range(runs)] or [first]), 3)
        print(f"{name:28} first {first:7.2f}s best {times[name]:7.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
