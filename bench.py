"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the table folder and ``BENCH_CPUS`` the number of cores.  Each query is
run to completion into a sink that drops the rows.  After one warm-up run the best of
``BENCH_RUNS`` runs counts.

The published single-thread run covers 8 145 462 datagrams, far more than the given tables
hold.  ``route_month_speed_8m`` computes the same report over the events table laid end to
end until it has that many rows, so that rates can be compared.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fleetcheck import inputs  # noqa: E402
from fleetcheck.queries import queries  # noqa: E402
from fleetspeed.plans.route_month import speed_report  # noqa: E402
from fleetspeed.session import local_session, work_folder  # noqa: E402

HEADLINE = (
    "route_month_speed",
    "route_month_speed_sorted",
    "route_month_speed_arrival",
    "run_metrics",
    "rejects_by_reason",
    "csv_parse_roundtrip",
    "operational_state",
    "bus_updates",
    "signal_gaps",
    "latest_bus_state",
    "subscription_fanout",
    "update_speed_enriched",
    "alert_last_position",
    "lake_range_report",
)
BASELINE_ROWS = 8_145_462


def finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def long_lake(spark, sf_dir: str) -> tuple[str, int]:
    """The events laid end to end, written as a table of datagrams."""
    events = inputs.table(spark, sf_dir, "events")
    n = events.count()
    # Every copy starts at a multiple of all periods used by the derivation of datagrams.
    step = -(-n // 800) * 800
    copies = -(-BASELINE_ROWS // n)
    shifted = events.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn(
        "event_id", F.col("event_id") + F.col("_copy") * step
    )
    folder = work_folder(spark, "bench")
    inputs.as_datagrams(shifted.drop("_copy")).repartitionByRange(16, "seq").write.parquet(folder)
    return folder, n * copies


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session("bench", cores=cpus, memory=os.environ.get("BENCH_MEMORY", "12g"))
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        run = lambda: finish(registered[name](spark, sf_dir))  # noqa: B023, E731
        run()
        seconds[name] = round(min(timed(run) for _ in range(runs)), 3)

    extra = {}
    if os.environ.get("BENCH_LONG", "1") == "1":
        folder, rows = long_lake(spark, sf_dir)
        run = lambda: finish(speed_report(spark.read.parquet(folder), inputs.routes(spark, sf_dir)))
        best = min(timed(run) for _ in range(runs))
        extra = {
            "route_month_speed_8m": {
                "rows": rows,
                "sec": round(best, 3),
                "rows_per_sec": round(rows / best),
                "baseline_rows_per_sec": 559787,
            }
        }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
