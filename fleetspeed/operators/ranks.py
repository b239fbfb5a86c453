"""Exact ranks of rows within keys, whatever share of the rows one key holds.

A window over a key needs all its rows in one task.  Here the rows are range-partitioned by key and order,
so a large key lies in many consecutive pieces of even size; rows are numbered within key and
piece, and the rows of a key in earlier pieces, one number a piece, are added.

Rows that are equal in every column would all fall into one range.  ``counted`` keeps one of them with
the number of copies first, and ``with_copies`` lays them out again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspeed.session import work_folder

# Copies are laid out in two steps of at most this many rows each, so no long array is made.
COPIES_A_STEP = 1 << 16


def counted(df: DataFrame, copies: str) -> DataFrame:
    """Each different row once, with how often it stands; equal rows meet as partial counts."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def ranked(
    spark: SparkSession,
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    into: str,
    copies: str | None = None,
) -> DataFrame:
    """Add ``into``: how many rows of the same key come before, from 0; without keys, of all rows.

    ``order`` are ascending values and must be total within a key.  With ``copies`` a row counts as that many.  The rows are
    written to the shared folder, so that the pieces stay as they are.
    """
    keys, size = list(keys), F.col(copies) if copies else F.lit(1).cast("long")
    spots = [f"_order{k}" for k in range(len(order))]
    placed = df.select("*", *[c.alias(n) for c, n in zip(order, spots, strict=True)])
    dealt = placed.repartitionByRange(*keys, *spots).withColumn("_piece", F.spark_partition_id())
    folder = work_folder(spark, "ranks")
    dealt.write.parquet(folder)
    rows = spark.read.schema(dealt.schema).parquet(folder)

    pieces = rows.groupBy(*keys, "_piece").agg(F.sum(size).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a piece can have rows in earlier ones: at most one row a piece.
    before = pieces.withColumn("_before", F.sum("_rows").over(earlier)).where(F.col("_before").isNotNull())
    left, right = rows.alias("l"), F.broadcast(before.alias("r"))
    same = F.col("l._piece") == F.col("r._piece")
    for key in keys:
        same &= F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    within = Window.partitionBy(*keys, "_piece").orderBy(*spots).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return (
        left.join(right, same, "left")
        .select("l.*", F.coalesce("_before", zero).alias("_before"))
        .withColumn(into, F.col("_before") + F.coalesce(F.sum(size).over(within), zero))
        .select(*df.columns, into)
    )


def with_copies(df: DataFrame, rank: str, copies: str) -> DataFrame:
    """Every copy as a row of its own, with consecutive ranks."""
    columns = [c for c in df.columns if c not in (rank, copies)]
    start = F.lit(COPIES_A_STEP) * F.col("_step")
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES_A_STEP).cast("long"))
    last = F.least(F.lit(COPIES_A_STEP), F.col(copies) - start) - 1
    return (
        df.withColumn("_step", F.explode(steps))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .select(*columns, (F.col(rank) + start + F.col("_copy")).alias(rank))
    )
