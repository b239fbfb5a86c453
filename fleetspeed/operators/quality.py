"""Validation of datagrams, reject reasons, the accept/reject split and reject reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspeed.schema import NO_FIX

REJECT = "reject_reason"


def plausible() -> Column:
    """The part of the validity rule that needs no route catalogue."""
    return (
        (F.col("raw_lat") != NO_FIX)
        & (F.col("raw_lon") != NO_FIX)
        & (F.col("bus_id") > 0)
        & (F.col("trip_id") >= 0)
        & F.col("ts").isNotNull()
    )


def on_active_route(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows whose line is in the catalogue.

    No broadcast hint: the planner broadcasts the catalogue while its measured size allows it
    and otherwise shuffles, where adaptive execution splits a line that holds too many rows.
    """
    return df.join(routes.select("line_id"), "line_id", "left_semi")


def off_active_route(df: DataFrame, routes: DataFrame) -> DataFrame:
    return df.join(routes.select("line_id"), "line_id", "left_anti")


def valid_datagrams(df: DataFrame, routes: DataFrame) -> DataFrame:
    return on_active_route(df.where(plausible()), routes)


def with_reject_reason(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first rule a row breaks, NULL for an accepted row.

    A ``parse_error`` column (see ``sources.datagrams``) marks unreadable lines.
    """
    active = routes.select("line_id").distinct().withColumn("_active", F.lit(True))
    reason = (
        F.when(F.col("raw_lat") == NO_FIX, "LAT_MINUS_ONE")
        .when(F.col("raw_lon") == NO_FIX, "LON_MINUS_ONE")
        .when(F.col("bus_id") <= 0, "BUSID_NONPOSITIVE")
        .when(F.col("trip_id") < 0, "TRIPID_NEGATIVE")
        .when(F.col("_active").isNull(), "LINEID_NOT_ACTIVE")
        .when(F.col("ts").isNull(), "NULL_DATE")
        # A row that is neither valid nor broken by a named rule has a missing field.
        .when(~F.coalesce(plausible(), F.lit(False)), "UNKNOWN")
    )
    if "parse_error" in df.columns:
        malformed = F.concat(F.lit("MALFORMED:"), F.col("parse_error"))
        reason = F.when(F.col("parse_error").isNotNull(), malformed).otherwise(reason)
    return df.join(active, "line_id", "left").withColumn(REJECT, reason).drop("_active")


def accepted(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REJECT).isNull()).drop(REJECT)


def rejected(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col(REJECT).isNotNull())


def rejects_by_reason(tagged: DataFrame) -> DataFrame:
    return rejected(tagged).groupBy(F.col(REJECT).alias("reason")).agg(
        F.count(F.lit(1)).alias("rejects")
    )


def reject_sample(tagged: DataFrame, rows: int = 20) -> DataFrame:
    """The first rejects in arrival order."""
    return (
        rejected(tagged)
        .select("seq", "bus_id", "line_id", F.col(REJECT).alias("reason"))
        .orderBy("seq")
        .limit(rows)
    )


def accept_reject_counts(tagged: DataFrame) -> DataFrame:
    bad = F.col(REJECT).isNotNull()
    return tagged.groupBy("line_id").agg(
        F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected")
    )


def has_content(date_text: Column, bus_id: Column) -> Column:
    """Guard against empty records: a date text and a non-zero bus id are present."""
    return F.coalesce((date_text != "") & (bus_id != 0), F.lit(False))


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows in arrival order (the input cap of a replay)."""
    return df.orderBy("seq").limit(rows)
