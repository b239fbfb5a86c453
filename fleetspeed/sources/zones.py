"""Line-to-zone and user-to-zone maps from one JSON object."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions import text
from fleetspeed.schema import ZONE_MAP_SCHEMA


def read_zone_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(line_id, zone_id)`` and ``(user_id, zone_id)``; empty when the file is missing."""
    try:
        doc = spark.read.schema(ZONE_MAP_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        doc = spark.createDataFrame([], ZONE_MAP_SCHEMA)
    lines = _entries(doc, "lineToZone").select(text.to_int(F.col("key")).alias("line_id"), "zone_id")
    users = _entries(doc, "userToZone").select(F.col("key").alias("user_id"), "zone_id")
    return lines.where(F.col("line_id").isNotNull()), users


def _entries(doc: DataFrame, name: str) -> DataFrame:
    pairs = doc.select(F.explode(name).alias("key", "value")).where(F.col("value") >= 0)
    return pairs.select("key", F.col("value").cast("int").alias("zone_id"))
