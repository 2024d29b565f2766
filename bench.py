"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from noticeflow.session import get_spark  # noqa: E402
from noticeflow.workload import all_queries  # noqa: E402

HEADLINE = (
    "t02_fold_text",
    "t06_canonical_url",
    "p08_extract_generic",
    "p11_listing_items",
    "p14_extract_posts",
    "i03_new_notices",
    "i06_run_log",
    "q01_search_notices",
    "m02_match_alerts",
    "m04_match_stats",
    "o02_source_health",
    "o04_crawler_status",
    "c07_check_sources",
    "e07_resolve_sources",
    "v08_coverage_breakdown",
    "a04_resolve_redirects",
    "a07_page_signals",
    "a18_audit_sources",
    "a20_find_duplicates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", f"local[{cpus}]", cpus, "12g")
    queries, _ = all_queries()
    spark.read.parquet(f"{sf_dir}/part.parquet").count()  # start the engine
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
