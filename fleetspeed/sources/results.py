"""Speed-result CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions import text
from fleetspeed.schema import SPEED_SCHEMA


def read_speed_results(spark: SparkSession, path: str) -> DataFrame:
    """Ten columns; blank and header lines are skipped; any other bad row raises an error."""
    lines = spark.read.text(path).where(
        (text.trimmed(F.col("value")) != "") & ~F.col("value").startswith("lineId,")
    )
    return parse_speed_lines(lines)


def parse_speed_lines(lines: DataFrame) -> DataFrame:
    fields = lines.select("value", text.split_fields(F.col("value")).alias("_f"))
    complaint = F.concat(F.lit("invalid speed result row: "), F.col("value"))
    checked = F.when(F.size("_f") == len(SPEED_SCHEMA), F.col("_f")).otherwise(F.raise_error(complaint))
    rows = fields.select(checked.alias("_f"))
    columns = []
    for place, field in enumerate(SPEED_SCHEMA.fields):
        # A plain cast raises on unreadable numbers.
        columns.append(F.get("_f", F.lit(place)).cast(field.dataType).alias(field.name))
    return rows.select(*columns)
