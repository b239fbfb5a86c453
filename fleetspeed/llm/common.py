"""What the operators of this package share: table access, row identity and unused names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.session import work_folder

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there."""
    folder = work_folder(spark, purpose)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def unused(frame: DataFrame, name: str) -> str:
    """A column name the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def same_document(left: DataFrame, right: DataFrame, *also: str) -> Column:
    """Null-safe equality of ``doc_id`` and further columns."""
    condition = left["doc_id"].eqNullSafe(right["doc_id"])
    for name in also:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)
