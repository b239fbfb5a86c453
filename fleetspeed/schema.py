"""Schemas, fixed values and tunable limits shared by all operators.

``seq`` is the arrival order of a report: a BIGINT that grows with arrival and is
unique in the table.  ``sources.datagrams.stamp_arrival`` assigns it to raw files; it is
stored in the lake so that later reads see the same order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Coordinate scale, Earth radius (km), raw coordinate that means "no fix".
COORD_SCALE = 10_000_000
EARTH_RADIUS_KM = 6371.0088
NO_FIX = -1

# Status and state labels, reject reasons, alert texts.
OK, NO_DATA = "OK", "NO_DATA"
EN_ROUTE, STOPPED, NO_SIGNAL, CRITICAL = "EN_RUTA", "PARADO", "SIN_SENAL", "CRITICO"
ROUTINE, EXCEPTIONAL = "ROUTINE", "EXCEPTIONAL"
ROUTINE_EVENT_TYPES = (0, 1, 2)
ALERT_PRIORITY = "ALTA"
ALERT_TEXT_PREFIX = "Excepcional eventType="
UNKNOWN_ROUTE_NAME, UNKNOWN_ROUTE_TEXT = "UNKNOWN", "NA"
DEFAULT_ALERT_LAT, DEFAULT_ALERT_LON = 3.42, -76.52
DEFAULT_ZONE = ALL_ZONES = 0

# Sorts compare the first column first, so the most selective one leads.
TRIP_KEY = ("trip_id", "bus_id", "line_id")


@dataclass(frozen=True)
class Limits:
    """Thresholds; the defaults are those of the normative rule set."""

    max_gap_s: int = 300
    max_speed_kmh: float = 120.0
    signal_s: int = 60
    # Keys holding more rows than this are split into slices by the ordered operators.
    # None switches the check off (for inputs known to have no such keys).
    slice_rows: int | None = 500_000


DATAGRAM_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("register_date", T.StringType()),
        T.StructField("stop_id", T.IntegerType()),
        T.StructField("odometer", T.LongType()),
        T.StructField("raw_lat", T.IntegerType()),
        T.StructField("raw_lon", T.IntegerType()),
        T.StructField("task_id", T.IntegerType()),
        T.StructField("line_id", T.IntegerType()),
        T.StructField("trip_id", T.LongType()),
        T.StructField("unknown1", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("bus_id", T.IntegerType()),
    ]
)
# The twelve fields of a CSV line, in line order.
CSV_FIELDS = DATAGRAM_SCHEMA.fieldNames()[1:]

ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("line_id", T.IntegerType()),
        T.StructField("short_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

SPEED_SCHEMA = T.StructType(
    [
        T.StructField("line_id", T.IntegerType()),
        T.StructField("short_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("total_distance_km", T.DoubleType()),
        T.StructField("total_time_hours", T.DoubleType()),
        T.StructField("average_speed_kmh", T.DoubleType()),
        T.StructField("valid_segments", T.LongType()),
        T.StructField("skipped_segments", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)
SPEED_COLUMNS = SPEED_SCHEMA.fieldNames()

# Header texts of the two CSV products.
SPEED_CSV_HEADER = (
    "lineId,shortName,description,yearMonth,totalDistanceKm,totalTimeHours,"
    "averageSpeedKmH,validSegments,skippedSegments,status"
)
METRICS_CSV_HEADER = (
    "version,dataset,processedRows,validRows,skippedRows,executionTimeMs,"
    "throughputRowsPerSecond,memoryUsedMb,resultRows"
)

ZONE_MAP_SCHEMA = T.StructType(
    [
        T.StructField("lineToZone", T.MapType(T.StringType(), T.LongType())),
        T.StructField("userToZone", T.MapType(T.StringType(), T.LongType())),
    ]
)

UPDATE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("bus_id", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("line_id", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("zone_id", T.IntegerType()),
        T.StructField("operational_state", T.StringType()),
    ]
)
