"""Durable streaming sources: files that arrive in a landing folder.

The position in the source is kept in the checkpoint of the query, so a restarted query
goes on where it stopped.  Both limits bound one micro-batch, whatever has piled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from fleetspeed.schema import DATAGRAM_SCHEMA

BYTES_PER_TRIGGER = 128 << 20


def _paced(reader: DataStreamReader, files_per_trigger: int | None) -> DataStreamReader:
    # Spark takes one of the two limits, not both.
    if files_per_trigger is not None:
        return reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)


def stream_datagrams(
    spark: SparkSession,
    path: str,
    files_per_trigger: int | None = None,
    schema: T.StructType = DATAGRAM_SCHEMA,
) -> DataFrame:
    """Parquet files of datagrams (``seq`` given by the writer)."""
    return _paced(spark.readStream.schema(schema), files_per_trigger).parquet(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Text lines with what is needed to order them: file, its time, place in the file."""
    lines = _paced(spark.readStream, files_per_trigger).text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
