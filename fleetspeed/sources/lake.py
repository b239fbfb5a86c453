"""Reads of the partitioned datagram lake."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspeed.schema import DATAGRAM_SCHEMA, TRIP_KEY
from fleetspeed.sources.datagrams import parse_lines, readable, scan_lines

PARTITIONS = ("line_id", "year", "month")
TRIPS = "_trips"  # below the lake: the months in which each trip has reports, by load

# ``month`` is text so that its directory keeps the leading zero.
LAKE_SCHEMA = T.StructType(
    [f for f in DATAGRAM_SCHEMA.fields if f.name != "line_id"]
    + [
        T.StructField("line_id", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.StringType()),
    ]
)


def _month() -> Column:
    return F.col("year") * 100 + F.col("month").cast("int")


def read_lake(spark: SparkSession, lake: str) -> DataFrame:
    """All datagrams; an absent lake is empty."""
    try:
        # Directories of single loads lie below the partitions and are no column of the lake.
        return spark.read.schema(LAKE_SCHEMA).parquet(lake).select(*LAKE_SCHEMA.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LAKE_SCHEMA)


def read_load(spark: SparkSession, lake: str, load: str) -> DataFrame:
    """Datagrams of one load, pruned by its directories."""
    schema = T.StructType([*LAKE_SCHEMA.fields, T.StructField("load_id", T.StringType())])
    return spark.read.schema(schema).parquet(lake).where(F.col("load_id") == load).select(*LAKE_SCHEMA.fieldNames())


def trip_months(datagrams: DataFrame) -> DataFrame:
    """The trips of lake rows and the months (``yyyymm``) in which they have reports."""
    return datagrams.select(*TRIP_KEY, _month().alias("month_no")).distinct()


def _loads_present(spark: SparkSession, lake: str) -> DataFrame:
    """Loads that the paths of the lake's files name; no file is opened."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.parquet"}
    files = spark.read.format("binaryFile").options(**options).load(lake).select("_metadata.file_path")
    own = files.where(F.regexp_extract("file_path", "/line_id=([^/]+)/", 1) != "")
    return own.select(F.regexp_extract("file_path", "/load_id=([^/]+)/", 1).alias("load_id")).distinct()


def months_of_trips(spark: SparkSession, lake: str, first: str, last: str) -> list[int] | None:
    """All months (``yyyymm``) in which a trip with reports in a ``yyyy-MM`` range has any.

    The state of a trip is made of its own reports only, so other months do not matter for the range.
    The list is as long as the calendar at most.  None if a load of the lake has not noted its trips.
    """
    span = int(first.replace("-", "")), int(last.replace("-", ""))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LAKE_SCHEMA.fields if f.name in TRIP_KEY)
    try:
        noted = spark.read.schema(f"{schema}, month_no int, load_id string").parquet(f"{lake}/{TRIPS}")
        if _loads_present(spark, lake).join(noted.select("load_id").distinct(), "load_id", "left_anti").first():
            return None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # A trip is wanted if its months reach into the range; each trip is one small group.
    wanted = (
        noted.groupBy(*TRIP_KEY)
        .agg(F.collect_set("month_no").alias("months"))
        .where(F.exists("months", lambda m: m.between(*span)))
        .select(F.explode("months").alias("month_no"))
        .distinct()
    )
    return sorted(r["month_no"] for r in wanted.collect())


def lake_of_months(spark: SparkSession, lake: str, months: list[int]) -> DataFrame:
    """Datagrams of the listed months, pruned by directory."""
    return read_lake(spark, lake).where(_month().isin(months) if months else F.lit(False))


def lake_partition(spark: SparkSession, lake: str, line_id: int, year: int, month: int) -> DataFrame:
    """One partition, pruned by its directory; an absent one is empty."""
    return read_lake(spark, lake).where(
        (F.col("line_id") == line_id) & (F.col("year") == year) & (F.col("month") == f"{month:02d}")
    )


def lake_months(spark: SparkSession, lake: str, first: str, last: str) -> DataFrame:
    """Datagrams of an inclusive ``yyyy-MM`` range, pruned by directory."""
    span = int(first.replace("-", "")), int(last.replace("-", ""))
    return read_lake(spark, lake).where(_month().between(*span))


def lake_partitions(spark: SparkSession, lake: str) -> DataFrame:
    """The partitions present, from the paths of the files; no file is opened."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.parquet"}
    try:
        files = spark.read.format("binaryFile").options(**options).load(lake).select("_metadata.file_path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LAKE_SCHEMA).select(*PARTITIONS)
    part = lambda name: F.regexp_extract("file_path", f"/{name}=([^/]+)/", 1)
    return (
        files.where(part("line_id") != "")
        .select(part("line_id").cast("int").alias("line_id"), part("year").cast("int").alias("year"), part("month").alias("month"))
        .distinct()
    )


def csv_lake(spark: SparkSession, lake: str) -> DataFrame:
    """Lines of a lake of CSV files in ``lineId=/year=/month=`` directories, unreadable ones
    dropped; the partition columns come from the line itself."""
    return readable(parse_lines(scan_lines(spark, lake, recursiveFileLookup="true", pathGlobFilter="*.csv")))
