"""Coordinates, distance, segment acceptance and speed bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetspeed.schema import COORD_SCALE, EARTH_RADIUS_KM, Limits


def degrees_of(raw: Column) -> Column:
    """Raw integer coordinate to degrees."""
    return raw / F.lit(float(COORD_SCALE))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres, in the numerically stable atan2 form."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def hours_of(gap_us: Column) -> Column:
    """Duration in hours, counted in whole milliseconds."""
    return F.floor(gap_us / 1000) / F.lit(3_600_000.0)


def segment_ok(gap_us: Column, km: Column, limits: Limits) -> Column:
    """True for ``0 < gap <= max_gap`` and ``speed <= max_speed``; both upper ends are kept."""
    in_time = (gap_us >= 1000) & (gap_us <= limits.max_gap_s * 1_000_000)
    # The speed is only evaluated for positive gaps, so there is no division by zero.
    return F.when(in_time, km / hours_of(gap_us) <= limits.max_speed_kmh).otherwise(F.lit(False))


def segment_ok_whole_seconds(gap_us: Column, km: Column, limits: Limits) -> Column:
    """The same test on whole seconds, so gaps below one second are refused."""
    seconds = F.floor(gap_us / 1_000_000)
    in_time = (seconds > 0) & (seconds <= limits.max_gap_s)
    return F.when(in_time, km / hours_of(gap_us) <= limits.max_speed_kmh).otherwise(F.lit(False))


def speed_band(kmh: Column) -> Column:
    """Display band of a speed; an unknown speed has an empty band."""
    return (
        F.when(kmh.isNull(), F.lit(""))
        .when(kmh >= 15, F.lit("good"))
        .when(kmh >= 10, F.lit("med"))
        .otherwise(F.lit("bad"))
    )
