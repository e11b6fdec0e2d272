"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local
cores. Every query runs once; only the session start is outside the clock.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pulseloom import catalog
from pulseloom.session import local_session

HEADLINE = (
    "sessionize_60s",
    "sessionize_bucketed",
    "session_summary",
    "validate_signals",
    "insert_signals",
    "ingest_summary",
    "sanitize_documents",
    "sanitize_messages",
    "redact_payload",
    "message_match",
    "flagship_incidents",
    "analyze_incidents",
    "match_patterns",
    "related_incident",
    "claim_incidents",
    "correlate",
    "upsert_incidents",
    "retention_signals",
    "oldest_expired",
    "delivery_stats",
    "build_prompt",
    "stream_ingest",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.range(1).count()
    queries, times = catalog.queries(), {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if sys.stderr.isatty() or os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
