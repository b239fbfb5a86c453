"""Run counters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fleetspeed.operators.quality import REJECT


def run_metrics(tagged: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: processed, valid and skipped rows; skipped counts rejects and late rows."""
    bad = F.col(REJECT).isNotNull()
    rows = tagged.agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count_if(bad).alias("rejected_rows"),
        F.lit(0).cast("bigint").alias("late_rows"),
    )
    late = segments.agg(
        F.lit(0).cast("bigint").alias("processed_rows"),
        F.lit(0).cast("bigint").alias("rejected_rows"),
        F.count_if("late").alias("late_rows"),
    )
    # Two one-row frames are added up, which needs no join.
    total = rows.unionByName(late).agg(
        *[F.sum(c).alias(c) for c in ("processed_rows", "rejected_rows", "late_rows")]
    )
    skipped = F.col("rejected_rows") + F.col("late_rows")
    return total.select(
        "processed_rows",
        (F.col("processed_rows") - skipped).alias("valid_rows"),
        skipped.alias("skipped_rows"),
    )


def run_metrics_row(
    counters: DataFrame,
    version: str,
    dataset: str,
    elapsed_ms: int,
    result_rows: int,
    memory_mb: float = 0.0,
    worker_count: int | None = None,
) -> DataFrame:
    """The counters with the facts of the run, ready for ``sinks.results.metrics_csv``."""
    seconds = elapsed_ms / 1000.0
    rate = F.col("processed_rows") / seconds if seconds > 0 else F.col("processed_rows").cast("double")
    row = counters.select(
        F.lit(version).alias("version"),
        F.lit(dataset).alias("dataset"),
        "processed_rows",
        "valid_rows",
        "skipped_rows",
        F.lit(elapsed_ms).cast("bigint").alias("elapsed_ms"),
        rate.alias("rows_per_second"),
        F.lit(float(memory_mb)).alias("memory_mb"),
        F.lit(result_rows).cast("bigint").alias("result_rows"),
    )
    return row if worker_count is None else row.withColumn("worker_count", F.lit(worker_count))


def used_heap_mb(spark: SparkSession) -> float:
    """Heap that the driver's JVM uses now."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return (runtime.totalMemory() - runtime.freeMemory()) / (1 << 20)


def measured_run(
    spark: SparkSession,
    tagged: DataFrame,
    segments: Callable[[DataFrame], DataFrame],
    report: Callable[[DataFrame], DataFrame],
    target: str,
    version: str,
    dataset: str,
) -> DataFrame:
    """Run a report from tagged datagrams into ``target`` and give the one row of facts about that run.

    Rows are counted by observations while they pass and time by the clock around the write, so nothing is
    computed again for the metrics.
    """
    counted, rows = observed(tagged, "measured-rows")
    late, done = Observation("measured-late"), Observation("measured-result")
    cut = segments(counted.where(F.col(REJECT).isNull()).drop(REJECT)).observe(late, F.count_if("late").alias("late"))
    started, before = time.perf_counter(), used_heap_mb(spark)
    report(cut).observe(done, F.count(F.lit(1)).alias("rows")).write.parquet(target)
    elapsed_ms = max(1, round((time.perf_counter() - started) * 1000))
    memory = max(before, used_heap_mb(spark))
    skipped = rows.get["rejected"] + late.get["late"]
    facts = [(rows.get["processed"], rows.get["processed"] - skipped, skipped)]
    counters = spark.createDataFrame(facts, "processed_rows long, valid_rows long, skipped_rows long")
    return run_metrics_row(counters, version, dataset, elapsed_ms, done.get["rows"], memory)


def observed(tagged: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Count processed, accepted and rejected rows while the frame is written, in one pass."""
    watch = Observation(name)
    bad = F.col(REJECT).isNotNull()
    counted = tagged.observe(
        watch,
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("rejected"),
    )
    return counted, watch


def stream_counters(raw: DataFrame) -> DataFrame:
    """Consumed, published and skipped rows of the live consumer.

    Records without a date or with bus id 0 are skipped before they count as consumed.
    """
    empty = F.col("ts").isNull() | (F.col("bus_id") == 0)
    return raw.agg(
        F.count_if(~empty).alias("consumed"),
        F.count_if(~empty).alias("published"),
        F.count_if(empty).alias("skipped"),
    )
