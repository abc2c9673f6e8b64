"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from murmur.plans import catalog
from murmur.session import local_session

HEADLINE = [
    "burst_windows",
    "burst_windows_wide",
    "burst_cross_source",
    "burst_members",
    "evidence_refs",
    "baseline_z",
    "readiness",
    "source_health",
    "extracted_content",
    "dom_channel_pages",
    "content_reobservation",
    "reprocess_outcomes",
    "whitespace_norm",
    "deterministic_ids",
    "manifest_digest",
    "chain_append",
    "chain_verify",
    "bundle_outcomes",
    "archive_verify",
    "provenance_trace",
    "export_digests",
    "access_decisions",
    "audit_verify",
    "stream_bursts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("max(ts)").collect()
    times = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
