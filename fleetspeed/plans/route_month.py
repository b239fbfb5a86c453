"""Route-month speed from raw files, from the lake, and for a month range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions.timekeys import month_text, shift_month
from fleetspeed.operators import quality, speed
from fleetspeed.operators.metrics import observed
from fleetspeed.operators.segments import trip_segments
from fleetspeed.schema import Limits
from fleetspeed.sinks import lake as lake_sink
from fleetspeed.sinks import loads
from fleetspeed.sinks.results import write_speed_csv
from fleetspeed.sources import datagrams as datagram_source
from fleetspeed.sources import lake as lake_source


def speed_report(datagrams: DataFrame, routes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The complete report over all observed months, by the normative rules."""
    valid = quality.valid_datagrams(datagrams, routes)
    totals = speed.route_month_totals(trip_segments(valid, limits))
    return speed.complete_report(totals, routes)


def build_lake(
    spark: SparkSession, routes: DataFrame, lake: str, *paths: str, load: str | None = None
) -> dict[str, int]:
    """Scan, validate and archive raw files as one load; returns the counters of the run.

    The counters are observed while the lake is written, so the input is read once.  Without a name
    the load is a new one; a load repeated under its name replaces itself.
    """
    files = datagram_source.files_below(spark, *paths)
    load = load or loads.next_load(spark, lake)
    first = loads.reserve(spark, lake, load, datagram_source.numbers_of(files))
    lines = datagram_source.stamp_arrival(spark.read.text(list(paths)), files, first)
    parsed = datagram_source.parse_lines(lines)
    tagged, watch = observed(quality.with_reject_reason(parsed, routes), "lake")
    lake_sink.write_lake(quality.accepted(tagged), lake, load)
    return watch.get


def lake_totals(
    spark: SparkSession,
    lake: str,
    first: str,
    last: str,
    limits: Limits = Limits(),
    mode: str = "normative",
    context_months: int | None = None,
) -> DataFrame:
    """Totals of a month range from the lake, whose rows were validated when written.

    In the normative mode the state of a trip carries over from month to month, so all reports of the
    trips with reports in the range are needed.  Loads note the months of their trips, and
    only the directories of those months are read; a lake with loads that did not is read whole.
    With ``context_months`` that many months before and after the range are read instead, which
    is exact where no trip id is used again later.  The other modes look at one month at a time.
    """
    if mode != "normative":
        rows = lake_source.lake_months(spark, lake, first, last)
    elif context_months is None:
        months = lake_source.months_of_trips(spark, lake, first, last)
        whole = months is None
        rows = lake_source.read_lake(spark, lake) if whole else lake_source.lake_of_months(spark, lake, months)
    else:
        span = shift_month(first, -context_months), shift_month(last, context_months)
        rows = lake_source.lake_months(spark, lake, *span)
    totals = speed.route_month_totals(trip_segments(rows, limits, mode))
    return totals.where(F.col("year_month").between(first, last))


def run_range(
    spark: SparkSession,
    lake: str,
    routes: DataFrame,
    first: tuple[int, int],
    last: tuple[int, int],
    limits: Limits = Limits(),
    mode: str = "normative",
    context_months: int | None = None,
) -> DataFrame:
    """Report of an inclusive month range: one job for all months."""
    span = month_text(*first), month_text(*last)
    totals = lake_totals(spark, lake, *span, limits, mode, context_months)
    return speed.range_report(totals, routes, *span)


def write_range(report: DataFrame, path: str) -> None:
    """Result file of a range run, by month then line."""
    write_speed_csv(report, path)


def run_month(
    spark: SparkSession, lake: str, routes: DataFrame, year: int, month: int, **options
) -> DataFrame:
    return run_range(spark, lake, routes, (year, month), (year, month), **options)
