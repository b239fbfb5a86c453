"""Loads of a lake: which sequence numbers each of them owns.

Bulk loads and micro-batches append to one lake.  Every load reserves the numbers that its files
need, behind all earlier loads, so arrival order is unique and grows over loads of either kind.
A load that is repeated gets the numbers it had.  Loads of one lake are made one after the other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD_ID = "load_id"
_SCHEMA = "load string, first bigint, size bigint"


def read_loads(spark: SparkSession, lake: str) -> DataFrame:
    """``load``, ``first`` and ``size`` of every load; an absent lake has none."""
    try:
        return spark.read.schema(_SCHEMA).parquet(f"{lake}/_loads")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def reserve(spark: SparkSession, lake: str, load: str, size: int) -> int:
    """First sequence number of a load of ``size`` numbers."""
    own = F.when(F.col("load") == load, F.struct("first", "size"))
    own, end = read_loads(spark, lake).agg(F.max(own), F.max(F.col("first") + F.col("size"))).first()
    if own:
        if own["size"] != size:
            raise ValueError(f"load {load} had {own['size']} numbers of input, now {size}")
        return own["first"]
    first = end or 0
    if first + size >= 1 << 63:
        raise OverflowError("the sequence numbers of this lake are used up")
    row = spark.range(1).select(F.lit(load).alias("load"), F.lit(first).cast("long").alias("first"), F.lit(size).cast("long").alias("size"))
    row.coalesce(1).write.mode("append").parquet(f"{lake}/_loads")
    return first


def next_load(spark: SparkSession, lake: str) -> str:
    return f"bulk-{read_loads(spark, lake).where(F.col('load').startswith('bulk-')).count()}"
