"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (timed runs per query after one warm-up, default 2),
     BENCH_ALL=1 to time every registered query instead of the headline set.
Each run executes the full plan into the no-op sink (nothing is collected).
The timed plans are the library results; the 4-dp rounding that registered
queries add for the oracle comparison is left out.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top10_products", "ingest_numeric", "quality_split", "facts_normalised", "semantic_view",
    "kpi_table", "ranking_detail", "channel_gap_by_date", "dashboard_records", "client_summary",
    "increments", "increments_raw_rows", "forecast_table", "forecast_date_axis",
    "forecast_product_date_axis", "executive_summary", "product_alerts", "scale_pair_sales",
    "scale_upsert", "scale_to_facts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))

    from tambo.registry import RAW, queries
    from tambo.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="tambo-bench")
    spark.conf.set("spark.tambo.spreadScans", "true")       # the bench's files have one row group each
    queries()
    qs = RAW        # library results as computed, without the 4-dp comparison rounding
    names = list(qs) if os.environ.get("BENCH_ALL") == "1" else [n for n in HEADLINE if n in qs]
    timings: dict[str, float] = {}
    for name in names:
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
