"""Route-month speed: totals, merging, months, complete reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspeed.functions.geo import hours_of
from fleetspeed.functions.timekeys import month_number, month_of_number, months_between
from fleetspeed.schema import (
    NO_DATA,
    OK,
    SPEED_COLUMNS,
    UNKNOWN_ROUTE_NAME,
    UNKNOWN_ROUTE_TEXT,
)

ROUTE_MONTH = ("line_id", "year_month")
MEASURES = ("total_distance_km", "total_time_hours", "valid_segments", "skipped_segments")


def route_month_totals(segments: DataFrame, *part: str) -> DataFrame:
    """Sums per line and month over all valid datagrams.

    Rows that close no segment add nothing but keep their month present, so the months of
    the result are exactly the observed months.  With ``part`` columns (a bus shard, a day)
    the result holds partial totals for ``merged_totals``.
    """
    good = F.col("segment_ok")
    hours = hours_of(F.col("gap_us"))
    sums = segments.groupBy(*part, "line_id", "month_no").agg(
        F.coalesce(F.sum(F.when(good, F.col("km"))), F.lit(0.0)).alias("total_distance_km"),
        F.coalesce(F.sum(F.when(good, hours)), F.lit(0.0)).alias("total_time_hours"),
        F.count_if(good).alias("valid_segments"),
        F.count_if(F.col("late") | ~good).alias("skipped_segments"),
    )
    return sums.select(
        *part, "line_id", month_of_number(F.col("month_no")).alias("year_month"), *MEASURES
    )


def merged_totals(*parts: DataFrame) -> DataFrame:
    """Totals of disjoint inputs (bus shards, days, months) added up."""
    union = parts[0].select(*ROUTE_MONTH, *MEASURES)
    for part in parts[1:]:
        union = union.unionByName(part.select(*ROUTE_MONTH, *MEASURES))
    return union.groupBy(*ROUTE_MONTH).agg(*[F.sum(m).alias(m) for m in MEASURES])


def observed_months(valid: DataFrame) -> DataFrame:
    """Months of the valid datagrams, late ones included."""
    numbers = valid.select(month_number(F.col("ts")).alias("month_no")).distinct()
    return numbers.select(month_of_number(F.col("month_no")).alias("year_month"))


def _graded(df: DataFrame) -> DataFrame:
    has_data = F.col("valid_segments") > 0
    return df.select(
        "line_id",
        "short_name",
        "description",
        "year_month",
        "total_distance_km",
        "total_time_hours",
        F.when(has_data, F.col("total_distance_km") / F.col("total_time_hours"))
        .otherwise(F.lit(0.0))
        .alias("average_speed_kmh"),
        "valid_segments",
        "skipped_segments",
        F.when(has_data, F.lit(OK)).otherwise(F.lit(NO_DATA)).alias("status"),
    )


def _or_zero(measure: str, value: Column) -> Column:
    kind = "bigint" if measure.endswith("segments") else "double"
    return F.coalesce(value, F.lit(0).cast(kind)).alias(measure)


def complete_report(totals: DataFrame, routes: DataFrame) -> DataFrame:
    """Every catalogued route in every observed month, in month-then-line order.

    The months come out of the totals themselves: per month the totals are gathered in a map by
    line (at most one entry per catalogued route), then the catalogue is laid over each
    month.  So the datagrams are read and segmented once, and no join with a grid is needed.
    """
    entry = F.struct(F.col("line_id"), F.struct(*MEASURES))
    months = totals.groupBy("year_month").agg(
        F.map_from_entries(F.collect_list(entry)).alias("cells")
    )
    catalogue = routes.agg(
        F.collect_list(F.struct("line_id", "short_name", "description"))
    ).scalar()
    grid = months.select("year_month", "cells", F.explode(catalogue).alias("route")).select(
        "year_month", "route.*", F.try_element_at("cells", F.col("route.line_id")).alias("cell")
    )
    filled = grid.select(
        "line_id",
        "short_name",
        "description",
        "year_month",
        *[_or_zero(m, F.col("cell")[m]) for m in MEASURES],
    )
    return in_report_order(_graded(filled))


def range_report(totals: DataFrame, routes: DataFrame, first: str, last: str) -> DataFrame:
    """Every catalogued route in every month of an inclusive range, observed or not."""
    grid = routes.select(
        "line_id", "short_name", "description", F.explode(months_between(first, last)).alias("year_month")
    )
    wanted = totals.where(F.col("year_month").between(first, last))
    filled = grid.join(wanted, list(ROUTE_MONTH), "left").select(
        "line_id",
        "short_name",
        "description",
        "year_month",
        *[_or_zero(m, F.col(m)) for m in MEASURES],
    )
    return in_report_order(_graded(filled))


def month_report(totals: DataFrame, routes: DataFrame, month: str) -> DataFrame:
    return range_report(totals, routes, month, month)


def named_report(totals: DataFrame, routes: DataFrame) -> DataFrame:
    """Only the observed cells; lines missing from the catalogue get placeholder names."""
    named = totals.join(routes.select("line_id", "short_name", "description"), "line_id", "left")
    return in_report_order(
        _graded(
            named.withColumn("short_name", F.coalesce("short_name", F.lit(UNKNOWN_ROUTE_NAME)))
            .withColumn("description", F.coalesce("description", F.lit(UNKNOWN_ROUTE_TEXT)))
        )
    )


def in_report_order(report: DataFrame) -> DataFrame:
    return report.select(*SPEED_COLUMNS).orderBy("year_month", "line_id")


def partition_metrics(segments: DataFrame) -> DataFrame:
    """Per line and month: rows read, valid segments, segments dropped, missing coordinates."""
    year, month = (F.col("month_no") / 100).cast("int"), F.col("month_no") % 100
    return segments.groupBy("line_id", year.alias("year"), month.alias("month")).agg(
        F.count(F.lit(1)).alias("datagrams_read"),
        F.count_if("segment_ok").alias("valid_segments"),
        F.count_if(~F.col("segment_ok")).alias("outliers_dropped"),
        F.lit(0).cast("bigint").alias("minus_one_filtered"),
    )
