"""Partitioned lake and bus shards.

Both writers use the rebalance hint: rows of one directory are brought together so that few
files are written, and adaptive execution splits a directory that holds too many rows over
several tasks (and files) by measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions import text
from fleetspeed.schema import DATAGRAM_SCHEMA
from fleetspeed.sinks.loads import LOAD_ID, read_loads
from fleetspeed.sources.datagrams import once
from fleetspeed.sources.lake import PARTITIONS, TRIPS, read_lake, read_load, trip_months

MAX_ROWS_PER_FILE = 20_000_000


def with_partition_columns(datagrams: DataFrame) -> DataFrame:
    return (
        datagrams.select(*[c for c in DATAGRAM_SCHEMA.fieldNames() if c in datagrams.columns])
        .withColumn("year", F.year("ts"))
        .withColumn("month", F.date_format("ts", "MM"))
    )


def write_lake(valid: DataFrame, lake: str, load: str = "bulk-0", held: bool = False) -> None:
    """Valid datagrams under ``line_id=<n>/year=<yyyy>/month=<mm>/load_id=<load>``; ``seq`` is stored.

    A load owns its directories, so a repeated load replaces itself and nothing else.  The months of
    its trips are noted below ``_trips``, from the columns of keys of the files just written.  With ``held`` the rows are
    persisted and the months come from them: finding its files lists the whole lake, too much for each of many small loads.
    """
    rows = with_partition_columns(valid)
    (
        rows.withColumn(LOAD_ID, F.lit(load))
        .hint("rebalance", *PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy(*PARTITIONS, LOAD_ID)
        .parquet(lake)
    )
    trips = trip_months(rows if held else read_load(valid.sparkSession, lake, load))
    trips.withColumn(LOAD_ID, F.lit(load)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(LOAD_ID).parquet(f"{lake}/{TRIPS}")


def compact_lake(spark: SparkSession, lake: str, target: str) -> None:
    """A copy of the lake in which all loads of a partition share its files; the loads stay known."""
    write_lake(read_lake(spark, lake), target, "compacted")
    read_loads(spark, lake).coalesce(1).write.mode("overwrite").parquet(f"{target}/_loads")


def shard_of(bus_id: Column, shards: int) -> Column:
    return F.pmod(bus_id, F.lit(shards))


def with_shard(lines: DataFrame, shards: int, drop_unreadable: bool = True) -> DataFrame:
    """Add ``bus_id`` and ``shard`` to raw lines.

    Lines without a positive bus id are dropped, or kept in shard 0 on request.
    """
    if shards <= 0:
        raise ValueError("shards must be positive")
    bus_id = text.to_int(text.trimmed(F.get(text.split_fields(F.col("value")), F.lit(11))))
    tagged = once(lines, bus_id, "bus_id")
    if drop_unreadable:
        tagged = tagged.where(F.col("bus_id") > 0)
    return tagged.withColumn("shard", F.coalesce(shard_of(F.col("bus_id"), shards), F.lit(0)))


def write_shards(lines: DataFrame, target: str, shards: int = 20) -> None:
    """Raw lines as text under ``shard=chunk-<nn>``, replacing what is there.

    Lines that come with a ``seq`` are in its order within each file.
    """
    chunk = F.concat(F.lit("chunk-"), F.lpad(F.col("shard").cast("string"), 2, "0"))
    order = [c for c in ("seq",) if c in lines.columns]
    (
        with_shard(lines, shards)
        .select("value", chunk.alias("shard"), *order)
        .hint("rebalance", "shard")
        .sortWithinPartitions("shard", *order)
        .select("value", "shard")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("shard")
        .text(target)
    )
