"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wireloom.plans.queries import QUERIES
from wireloom.session import build_session

HEADLINE = [
    "classify_risk", "incident_stats", "attack_category", "payload_entropy", "ip_diversity", "flow_features",
    "robust_zscore", "map_mitre", "first_match_join", "dedup_incidents", "detect_incidents", "risk_timeline",
    "mitre_heatmap", "daily_report", "normalize_eve", "normalize_zeek_tsv", "normalize_csv", "route_formats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # also starts the executors
    seconds, rates = {}, {}
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("attack_category")  # warm-up, not timed
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        times = []
        for _ in range(2):  # the better of two runs counts
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        rates[name] = round(events / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "events_per_sec": rates,
                "events": events,
                "cpus": int(cpus),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
