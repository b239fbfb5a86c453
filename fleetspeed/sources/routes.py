"""Route catalogue from CSV with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions import text
from fleetspeed.schema import ROUTE_SCHEMA
from fleetspeed.sources.datagrams import scan_lines

REQUIRED = ("LINEID", "SHORTNAME", "DESCRIPTION")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Columns are found by header name in any case; short rows and rows without an integer id
    are left out; the last row of a repeated id counts.  An empty file gives no routes."""
    lines = scan_lines(spark, path)
    head = lines.orderBy("seq").limit(1).select(text.split_fields(F.col("value")).alias("h"), "seq")
    first = head.first()
    if first is None:
        return spark.createDataFrame([], ROUTE_SCHEMA)
    names = [h.strip().upper() for h in first["h"]]
    missing = [n for n in REQUIRED if n not in names]
    if missing:
        raise ValueError(f"missing required route CSV header: {', '.join(missing)}")
    places = [names.index(n) for n in REQUIRED]

    fields = lines.where(F.col("seq") != first["seq"]).select(
        "seq", text.split_fields(F.col("value")).alias("_f")
    )
    line_id, short_name, description = (text.trimmed(F.get("_f", F.lit(p))) for p in places)
    rows = fields.where(F.size("_f") > max(places)).select(
        "seq",
        text.to_int(line_id).alias("line_id"),
        short_name.alias("short_name"),
        description.alias("description"),
    )
    latest = F.max(F.struct("seq", "short_name", "description"))
    return (
        rows.where(F.col("line_id").isNotNull())
        .groupBy("line_id")
        .agg(latest.alias("_last"))
        .select("line_id", "_last.short_name", "_last.description")
    )
