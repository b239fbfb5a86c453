"""Trip segmentation: consecutive reports of one vehicle trip become segments.

Three ways to choose the earlier end of a segment are offered:

``normative``  a report that is not newer than all earlier ones of its trip is late: it is
               counted as skipped and ignored afterwards.
``sorted``     reports of a trip and month are ordered by time first, so none is late.
``arrival``    reports of a trip and month are paired as they arrived, late ones too.

Result columns: the trip key, ``seq``, ``ts_us`` (microseconds since 1970), ``lat``, ``lon``,
``month_no``, ``late``, ``gap_us``, ``km`` and ``segment_ok``.  The last one is NULL where a
report closes no segment (first of its trip, or late).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspeed.functions import geo
from fleetspeed.functions.timekeys import epoch_micros, month_number, month_of_number
from fleetspeed.operators.arrival import prior_max
from fleetspeed.schema import TRIP_KEY, Limits

MODES = ("normative", "sorted", "arrival")


def located(df: DataFrame) -> DataFrame:
    """The columns segmentation needs, as plain numbers; all others are pruned."""
    return df.select(
        *TRIP_KEY,
        "seq",
        epoch_micros(F.col("ts")).alias("ts_us"),
        geo.degrees_of(F.col("raw_lat")).alias("lat"),
        geo.degrees_of(F.col("raw_lon")).alias("lon"),
    )


def trip_segments(valid: DataFrame, limits: Limits = Limits(), mode: str = "normative") -> DataFrame:
    """One row per valid datagram with the segment it closes."""
    rows, place, slices = located(valid), ["lat", "lon"], limits.slice_rows
    if mode == "normative":
        # The newest report so far is the one the next newer report is paired with, and a
        # report is late when it is not newer than that.  With equal times the first arrival
        # stands, hence the negated sequence.  One running maximum answers both questions.
        rows = rows.withColumn("first", -F.col("seq"))
        paired = prior_max(rows, TRIP_KEY, ["seq"], ["ts_us", "first"], place, "prev", slices)
        late = F.coalesce(F.col("ts_us") <= F.col("prev.ts_us"), F.lit(False))
        return with_segment(paired.drop("first"), late, geo.segment_ok, limits)

    # The other two modes see one line and month at a time and leave out line -1.
    rows = rows.where(F.col("line_id") != -1).withColumn("month_no", _month_no())
    keys = [*TRIP_KEY, "month_no"]
    if mode == "sorted":
        paired = prior_max(rows, keys, ["ts_us", "seq"], ["ts_us", "seq"], place, "prev", slices)
    elif mode == "arrival":
        paired = prior_max(rows, keys, ["seq"], ["seq"], ["ts_us", *place], "prev", slices)
    else:
        raise ValueError(f"mode must be one of {MODES}: {mode}")
    return with_segment(paired, F.lit(False), geo.segment_ok_whole_seconds, limits)


def with_segment(paired: DataFrame, late: Column, accept, limits: Limits) -> DataFrame:
    """Gap, distance and acceptance between ``prev`` and the row itself."""
    gap = F.when(~F.col("late"), F.col("ts_us") - F.col("prev.ts_us"))
    km = geo.haversine_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    measured = (
        paired.withColumn("late", late)
        .withColumn("gap_us", gap)
        .withColumn("km", F.when(F.col("gap_us").isNotNull(), km))
    )
    ok = F.when(F.col("gap_us").isNotNull(), accept(F.col("gap_us"), F.col("km"), limits))
    return (
        measured.withColumn("segment_ok", ok).withColumn("month_no", _month_no()).drop("prev")
    )


def _month_no() -> Column:
    return month_number(F.timestamp_micros("ts_us"))


def segment_table(segments: DataFrame) -> DataFrame:
    """Closed segments with distance, duration and speed, for inspection."""
    hours = geo.hours_of(F.col("gap_us"))
    return segments.where(F.col("segment_ok").isNotNull()).select(
        "seq",
        *TRIP_KEY,
        month_of_number(F.col("month_no")).alias("year_month"),
        "km",
        (F.col("gap_us") / 1_000_000).alias("seconds"),
        F.when(F.col("gap_us") >= 1000, F.col("km") / hours).alias("kmh"),
        "segment_ok",
    )
