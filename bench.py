"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then twice; the better time counts. Results are written to Spark's `noop` sink, so
every row and column is computed and nothing is collected.
"""

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmark.plans import load  # noqa: E402
from trailmark.session import session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

QUERIES = [
    "session_stats",
    "sessionize",
    "session_updates",
    "dedup_latest",
    "classify_telemetry",
    "event_rows",
    "ingest_report",
    "redact_text",
    "redact_url",
    "reject_unknown_refs",
    "rage_clicks",
    "dead_clicks",
    "signal_alerts",
    "funnel",
    "timeline",
    "click_map",
    "chunk_manifest",
    "replay_integrity",
    "nearest_insights",
    "offset_runs",
    "list_sessions",
    "events_stream",
]


def main() -> None:
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs, _ = load()
    times = {}
    for name in QUERIES:
        best = None
        for attempt in range(3):
            start = time.perf_counter()
            runs[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    rate = {name: round(events / times[name]) for name in ("classify_telemetry", "event_rows", "session_stats")}
    print(
        json.dumps(
            {
                "metric": "sum of best query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "events_per_second": rate,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
