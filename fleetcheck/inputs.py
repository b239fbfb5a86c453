"""Fleet inputs derived from the given tables by integer arithmetic.

There is no GPS table among the given ones, so every row of ``events`` becomes one datagram
and the dimension tables become the route catalogue, the zone maps and the subscriptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.schema import DATAGRAM_SCHEMA

# Valid in Spark SQL and in DuckDB; the oracle uses the same text.
DATAGRAM_EXPRS = {
    "seq": "event_id",
    "event_type": "CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2"
    " WHEN 'purchase' THEN 0 ELSE 50 END AS INT)",
    "register_date": "'28-MAY-19'",
    "stop_id": "CAST(500000 + event_id % 900 AS INT)",
    "odometer": "CAST(100 + (event_id - event_id % 16) / 16 AS BIGINT)",
    "raw_lat": "CAST(CASE WHEN event_id % 41 = 0 THEN -1"
    " ELSE 34000000 + ((event_id - event_id % 8) / 8 * 90000) % 4000000 END AS INT)",
    "raw_lon": "CAST(CASE WHEN event_id % 43 = 0 THEN -1"
    " ELSE -765000000 + (event_id % 8) * 1000 END AS INT)",
    "task_id": "CAST(757 AS INT)",
    "line_id": "CAST(CASE WHEN event_id % 61 = 0 THEN 999 WHEN event_id % 8 = 7 THEN -1"
    " ELSE 100 + event_id % 8 END AS INT)",
    "trip_id": "CAST(CASE WHEN event_id % 59 = 0 THEN -1"
    " ELSE (event_id - event_id % 800) / 800 END AS BIGINT)",
    "unknown1": "CAST(6255401365 + event_id AS BIGINT)",
    "bus_id": "CAST(CASE WHEN event_id % 47 = 0 THEN 0 ELSE 1 + event_id % 8 END AS INT)",
}
OFFSET_EXPR = (
    "event_id * 30 + CAST(floor(value * 100) AS BIGINT) % 181 - 90"
    " - CASE WHEN event_id % 53 = 0 THEN 600 ELSE 0 END"
)
ROUTE_LINE_EXPR = "CAST(CASE WHEN n_nationkey = 24 THEN -1 ELSE 100 + n_nationkey END AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_datagrams(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming frame of events."""
    start = "timestampadd(SECOND, {}, TIMESTAMP_NTZ '2018-05-31 20:00:00')"
    columns = [F.expr(sql).alias(name) for name, sql in DATAGRAM_EXPRS.items()]
    return events.select(*columns, F.expr(start.format(OFFSET_EXPR)).alias("ts")).select(
        *DATAGRAM_SCHEMA.fieldNames()
    )


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_datagrams(table(spark, sf_dir, "events"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.expr(ROUTE_LINE_EXPR).alias("line_id"),
        F.col("n_name").alias("short_name"),
        F.col("r_name").alias("description"),
    )


def line_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .select(F.expr(ROUTE_LINE_EXPR).alias("line_id"), F.expr("CAST(n_regionkey AS INT)").alias("zone_id"))
    )


def user_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_name").alias("user_id"), F.expr("CAST(s_nationkey % 5 AS INT)").alias("zone_id"))
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is a control room, of one zone or two; zone 0 means all."""
    first = "CAST(n_nationkey % 5 AS INT)"
    second = "CAST((n_nationkey + 1) % 5 AS INT)"
    rooms = F.expr(f"CASE WHEN n_nationkey % 2 = 0 THEN array({first}, {second}) ELSE array({first}) END")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("subscriber"), F.explode(rooms).alias("zone_id"))


def supplier_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of what every supplier listens to: a first version, and a second one for every third of them."""
    zone = F.expr("CAST(s_nationkey % 5 AS INT)")
    key = F.col("s_suppkey")
    versions = F.array(
        F.struct(F.lit(1).alias("version"), F.array(zone).alias("zones")),
        F.when(
            key % 3 == 0,
            F.struct(F.lit(2).alias("version"), F.when(key % 2 == 0, F.array(zone, (zone + 1) % 5)).otherwise(F.array().cast("array<int>")).alias("zones")),
        ),
    )
    changes = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("subscriber"), F.explode(F.array_compact(versions)).alias("v"))
    return changes.select("subscriber", "v.zones", "v.version")


def datagram_lines(datagrams_df: DataFrame) -> DataFrame:
    """Datagrams as CSV text, in line order of the fields; ``seq`` is kept beside the line.

    Every third line writes ``unknown1`` in scientific notation, every fifth one quotes the
    register date, every 97th one is cut short, so all parsing rules take part.
    """
    value = F.when(
        F.col("seq") % 3 == 0, F.concat((F.col("unknown1") / 1e9).cast("decimal(20,9)").cast("string"), F.lit("E9"))
    ).otherwise(F.col("unknown1").cast("string"))
    date = F.when(F.col("seq") % 5 == 0, F.lit('"28-MAY-19"')).otherwise(F.lit("28-MAY-19"))
    full = F.concat_ws(
        ",",
        "event_type",
        date,
        "stop_id",
        "odometer",
        "raw_lat",
        "raw_lon",
        "task_id",
        "line_id",
        "trip_id",
        value,
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "bus_id",
    )
    line = F.when(F.col("seq") % 97 == 0, F.lit("not,enough,fields")).otherwise(full)
    return datagrams_df.select("seq", line.alias("value"))
