"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagelake.plans.registry import load_all  # noqa: E402
from pagelake.session import build  # noqa: E402

HEADLINE = [
    "flagship_domain_summary",
    "h26_extract_record",
    "h16_page_text",
    "h24_link_edges",
    "s1_results_scan",
    "a1_a5_totals",
    "a7_frequency_maps",
    "x3_search",
    "w6_latest_per_url",
    "w2_health_walk",
    "w3_zero_floored_counters",
    "w4_circuit_breaker",
    "w5_failure_streaks",
    "h12_selector_fields",
    "x10_clean_text",
    "g3_pagerank",
    "k10_markdown_report",
    "p5_listings_zip",
    "w15_best_servers",
    "k3_expired_store",
]


def spread_pages(spark, sf_dir: str, parts: int) -> str:
    """``sf_dir`` with ``pages`` as several files, so that extraction runs on all cores.

    The given table is one file of one row group, which is one task.
    """
    out = tempfile.mkdtemp(prefix="pagelake-bench-")
    for name in os.listdir(sf_dir):
        if name != "pages.parquet":
            os.symlink(os.path.join(sf_dir, name), os.path.join(out, name))
    spark.read.parquet(os.path.join(sf_dir, "pages.parquet")).repartition(parts).write.parquet(os.path.join(out, "pages.parquet"))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build("pagelake-bench", cpus=cpus)
    given = sf_dir
    sf_dir = spread_pages(spark, given, 2 * cpus)
    registry = load_all()
    names = [n for n in HEADLINE if n in registry]
    # Warm-up: JVM, parquet footers, the regex engine and Python workers
    # (queries outside the headline list).
    for warm in ("s2_pages_scan", "h1_title", "x28_status_rules"):
        if warm in registry:
            registry[warm].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
