"""Result files: speed CSV, run metrics CSV, report store, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspeed.functions.text import fixed, quoted
from fleetspeed.operators.ranks import ranked
from fleetspeed.schema import METRICS_CSV_HEADER, SPEED_CSV_HEADER

REPORT_ORDER = ("year_month", "line_id")
STORE_ORDER = ("line_id", "year_month")


def speed_line() -> Column:
    """One CSV line of a report row: texts quoted, decimals 6, 9 and 6."""
    return F.concat_ws(
        ",",
        F.col("line_id").cast("string"),
        quoted(F.col("short_name")),
        quoted(F.col("description")),
        F.col("year_month"),
        fixed(F.col("total_distance_km"), 6),
        fixed(F.col("total_time_hours"), 9),
        fixed(F.col("average_speed_kmh"), 6),
        F.col("valid_segments").cast("string"),
        F.col("skipped_segments").cast("string"),
        F.col("status"),
    )


def _with_header(rows: DataFrame, header: str, order: tuple[str, ...]) -> DataFrame:
    """Header and lines in one sorted frame; part files in name order give the exact text."""
    head = rows.sparkSession.range(1).select(
        F.lit(0).alias("_part"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order],
        F.lit(header).alias("value"),
    )
    body = rows.select(F.lit(1).alias("_part"), *order, "value")
    return head.unionByName(body).orderBy("_part", *order).select("value")


def speed_csv(report: DataFrame, order: tuple[str, ...] = REPORT_ORDER) -> DataFrame:
    return _with_header(report.withColumn("value", speed_line()), SPEED_CSV_HEADER, order)


def write_speed_csv(report: DataFrame, path: str, order: tuple[str, ...] = REPORT_ORDER) -> None:
    speed_csv(report, order).write.mode("overwrite").text(path)


def write_store(report: DataFrame, path: str) -> None:
    """The whole report store, by line then month."""
    write_speed_csv(report, path, STORE_ORDER)


def metrics_csv(metrics: DataFrame) -> DataFrame:
    """Run metrics (see ``operators.metrics.run_metrics_row``); a ``worker_count`` is optional."""
    fields = [
        quoted(F.col("version")),
        quoted(F.col("dataset")),
        F.col("processed_rows").cast("string"),
        F.col("valid_rows").cast("string"),
        F.col("skipped_rows").cast("string"),
        F.col("elapsed_ms").cast("string"),
        fixed(F.col("rows_per_second"), 2),
        fixed(F.col("memory_mb"), 2),
        F.col("result_rows").cast("string"),
    ]
    header = METRICS_CSV_HEADER
    if "worker_count" in metrics.columns:
        fields.append(F.col("worker_count").cast("string"))
        header += ",workerCount"
    rows = metrics.withColumn("value", F.concat_ws(",", *fields))
    return _with_header(rows, header, ("version",))


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics_csv(metrics).write.mode("overwrite").text(path)


def _json_text(value: Column) -> Column:
    escaped = F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(escaped, F.lit('"'), F.lit('\\"')), F.lit('"'))


def report_json() -> Column:
    """One report row as a JSON object with a fixed field order."""
    fields = [
        ("lineId", F.col("line_id").cast("string")),
        ("shortName", _json_text(F.col("short_name"))),
        ("description", _json_text(F.col("description"))),
        ("yearMonth", _json_text(F.col("year_month"))),
        ("averageSpeedKmH", F.col("average_speed_kmh").cast("string")),
        ("totalDistanceKm", F.col("total_distance_km").cast("string")),
        ("totalTimeHours", F.col("total_time_hours").cast("string")),
        ("validSegments", F.col("valid_segments").cast("string")),
        ("skippedSegments", F.col("skipped_segments").cast("string")),
        ("status", _json_text(F.col("status"))),
    ]
    members = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def reports_json_array(report: DataFrame) -> DataFrame:
    """All report rows as one JSON array text, by month then line.

    For reports that fit in one row; ``reports_json_chunks`` has no such limit.
    """
    entries = F.array_sort(F.collect_list(F.struct(*REPORT_ORDER, report_json().alias("json"))))
    texts = F.transform(entries, lambda e: e["json"])
    return report.agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("json"))


def reports_json_chunks(report: DataFrame, rows: int = 10_000) -> DataFrame:
    """``(part, chunk, json)``: texts of at most ``rows`` rows each that make up the array in this order.

    Part 0 opens the array, part 2 closes it.
    """
    spark, order = report.sparkSession, [F.col(c) for c in REPORT_ORDER]
    placed = ranked(spark, report.select(*REPORT_ORDER, report_json().alias("json")), [], order, "_n")
    chunk = F.floor(F.col("_n") / rows).cast("long")
    entries = F.array_sort(F.collect_list(F.struct("_n", "json")))
    joined = F.array_join(F.transform(entries, lambda e: e["json"]), ",")
    comma = F.when(F.col("chunk") > 0, F.lit(",")).otherwise(F.lit(""))
    body = placed.groupBy(chunk.alias("chunk")).agg(joined.alias("json"))
    ends = spark.createDataFrame([(0, 0, "["), (2, 0, "]")], "part int, chunk long, json string")
    return ends.unionByName(body.select(F.lit(1).alias("part"), "chunk", F.concat(comma, "json").alias("json")))


def write_json_array(report: DataFrame, path: str, rows: int = 10_000) -> None:
    """One JSON array for reports of any size: the part files in name order."""
    reports_json_chunks(report, rows).orderBy("part", "chunk").select(F.col("json").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON object per line, for reports of any size."""
    report.orderBy(*REPORT_ORDER).select(report_json().alias("value")).write.mode("overwrite").text(path)
