"""Read side over speed reports: lookups, ranges, upsert, comparison, reconciliation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspeed.functions.geo import speed_band
from fleetspeed.functions.timekeys import month_text
from fleetspeed.schema import SPEED_COLUMNS

KEY = ("line_id", "year_month")


def point(reports: DataFrame, line_id: int, year: int, month: int) -> DataFrame:
    """One route in one month; no row means no data."""
    return reports.where(
        (F.col("line_id") == line_id) & (F.col("year_month") == month_text(year, month))
    )


def monthly(reports: DataFrame, year: int, month: int) -> DataFrame:
    return reports.where(F.col("year_month") == month_text(year, month))


def in_range(reports: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Inclusive range; the order of ``yyyy-MM`` texts is the order of the months."""
    return reports.where(F.col("year_month").between(month_text(*first), month_text(*last)))


def upsert(batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Reports of several numbered batches: the highest number wins per route and month."""
    rest = [c for c in SPEED_COLUMNS if c not in KEY]
    return (
        batches.groupBy(*KEY)
        .agg(F.max(F.struct(batch, *rest)).alias("_last"))
        .select(*[F.col(c) if c in KEY else F.col(f"_last.{c}") for c in SPEED_COLUMNS])
    )


def upserted(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after writing ``changes`` over it."""
    old = current.select(*SPEED_COLUMNS, F.lit(0).alias("batch"))
    new = changes.select(*SPEED_COLUMNS, F.lit(1).alias("batch"))
    return upsert(old.unionByName(new))


def save_months(reports: DataFrame, path: str) -> None:
    """Replace the months present in ``reports`` and leave the other months as they are."""
    (
        reports.select(*SPEED_COLUMNS)
        .hint("rebalance", "year_month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year_month")
        .parquet(path)
    )


def store_order(reports: DataFrame) -> DataFrame:
    return reports.orderBy("line_id", "year_month")


def comparison(reports: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Line, month, speed and its display band over a range."""
    return in_range(reports, first, last).select(
        "line_id", "year_month", "average_speed_kmh", speed_band(F.col("average_speed_kmh")).alias("band")
    )


def of_routes(reports: DataFrame, lines: Iterable[int]) -> DataFrame:
    """The chosen routes, fastest first."""
    return reports.where(F.col("line_id").isin(*lines)).orderBy(
        F.desc("average_speed_kmh"), "line_id", "year_month"
    )


def month_deltas(reports: DataFrame) -> DataFrame:
    """Change against the previous month of the route, largest change first.

    The window holds one route's months, which is a short list.
    """
    window = Window.partitionBy("line_id").orderBy("year_month")
    before = F.lag("average_speed_kmh").over(window)
    return (
        reports.select("line_id", "year_month", "average_speed_kmh", before.alias("previous_kmh"))
        .where(F.col("previous_kmh").isNotNull())
        .withColumn("delta_kmh", F.col("average_speed_kmh") - F.col("previous_kmh"))
        .orderBy(F.desc(F.abs("delta_kmh")), "line_id", "year_month")
    )


def preview(reports: DataFrame, rows: int = 30) -> DataFrame:
    return reports.orderBy("year_month", "line_id").limit(rows)


def run_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("status").agg(F.count(F.lit(1)).alias("reports"))


def reconcile(actual: DataFrame, expected: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Route-months that differ: missing on a side, or other speeds, segment counts or states.

    The tolerance is for speeds; counts must be equal.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *KEY,
            F.lit(True).alias(f"_in_{name}"),
            F.col("average_speed_kmh").alias(f"{name}_kmh"),
            F.col("valid_segments").alias(f"{name}_segments"),
            F.col("skipped_segments").alias(f"{name}_skipped"),
            F.col("status").alias(f"{name}_status"),
        )

    both = side(actual, "actual").join(side(expected, "expected"), list(KEY), "full_outer")
    return both.withColumn("difference", _difference(tolerance)).where(
        F.col("difference").isNotNull()
    ).drop("_in_actual", "_in_expected")


def _difference(tolerance: float) -> Column:
    return (
        F.when(F.col("_in_actual").isNull(), F.lit("MISSING"))
        .when(F.col("_in_expected").isNull(), F.lit("UNEXPECTED"))
        .when(F.abs(F.col("actual_kmh") - F.col("expected_kmh")) > tolerance, F.lit("SPEED"))
        .when(
            (F.col("actual_segments") != F.col("expected_segments"))
            | (F.col("actual_skipped") != F.col("expected_skipped")),
            F.lit("SEGMENTS"),
        )
        .when(F.col("actual_status") != F.col("expected_status"), F.lit("STATUS"))
    )
