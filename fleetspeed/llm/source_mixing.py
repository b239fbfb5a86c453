"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share 150 % of all
words.  A target stops at twice the words its source has; the excess goes to the other sources by
weight until none is above.  A source is taken whole as many times as fits its target (complete
epochs); the rest is a weighted sample without replacement: documents ordered by exponential keys
``-ln(u) / quality weight``, taken while the middle of a document lies within the rest.

The prefix sums run over (source, key range) parts, so a source with most of all rows is cut into
many tasks, and only one cut-off key a source goes back to the documents.

``u`` is a digest of ``doc_id``, so reruns agree.  Rows of one source with the same ``doc_id`` are one
item: taken together or not.  Null and empty texts have size 0 and take no words.  A null ``doc_id``
is an id like any other, a null source a source like any other.  Empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspeed.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2


@dataclass(frozen=True)
class Parts:
    """Rows aimed at in one part of a source, and the least number of parts."""

    rows: int = 200_000
    least: int = 64


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number between 0 and 1 that depends on the id alone."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row for each source."""
    # The order is numbered range by range; only row counts of ranges meet in one task.
    ranges = stored(
        spark,
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("_range", F.spark_partition_id())
        .select("source", "source_size", "_range"),
        "mix-sources",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = stored(
        spark,
        ranges.join(offsets, "_range")
        .withColumn("_place", place + F.col("_offset"))
        .select("source", "source_size", weight.cast("double").alias("_weight"), (F.col("source_size") * float(most)).alias("_cap")),
        "mix-ranked",
    )

    def totals(level: float) -> tuple[float, float, float, int]:
        full = F.col("_weight") * level > F.col("_cap")
        row = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight"))), F.count_if(full)
        ).first()
        return tuple(x or 0 for x in row)

    size, _, free, _ = totals(0.0)
    level, before_full = (share * size / free if free else 0.0), 0
    while True:
        _, capped, free, full = totals(level)
        if full == before_full or not free:
            break
        level, before_full = (share * size - capped) / free, full
    return ranked.select("source", "source_size", F.least(F.col("_weight") * level, "_cap").alias("target"))


def plan_mix(spark: SparkSession, docs: DataFrame, quality: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """One row for each source: sizes, target, complete epochs and the last key of the sample.

    ``docs`` has ``doc_id``, ``source`` and ``size``; ``quality`` has ``doc_id`` and ``weight``, above 0.
    """
    items = stored(
        spark, docs.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("_rows")), "mix-items"
    )
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(spark, sizes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stored(
        spark,
        targets.withColumn("epochs", epochs.cast("int")).withColumn(
            "_rest", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        "mix-targets",
    )
    weight = F.coalesce(F.when(F.col("weight") > 0, F.col("weight")), F.lit(1.0))
    n_parts = max(parts.least, -(-items.count() // parts.rows))
    keyed = (
        items.join(quality.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
        .withColumn("_key", -F.ln(draw(F.col("doc_id"))) / weight)
        .withColumn("_part", F.floor((1 - F.exp(-F.col("_key"))) * n_parts).cast("int"))
    )
    by_part = keyed.groupBy("source", "_part").agg(F.sum("size").alias("_part_size"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("source", "_part", F.coalesce(F.sum("_part_size").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_part").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumn("_sum", F.sum("size").over(within)).alias("a")
    placed = summed.join(
        offsets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._part") == F.col("b._part"))
    ).select("a.*", "_offset")
    middle = F.col("_offset") + F.col("_sum") - F.col("size") / 2
    last = (
        placed.alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .where(middle <= F.col("_rest"))
        .groupBy("p.source")
        .agg(F.max(F.struct("_key", "doc_id")).alias("last"))
    )
    return stored(
        spark,
        targets.alias("t")
        .join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
        .select("t.source", "source_size", "target", "epochs", "last"),
        "mix-plan",
    )


def apply_mix(docs: DataFrame, quality: DataFrame, plan: DataFrame, copies: str, keep: list[str]) -> DataFrame:
    """The documents with the number of copies the mix takes and the named columns of their source's plan."""
    weight = F.coalesce(F.when(F.col("q.weight") > 0, F.col("q.weight")), F.lit(1.0))
    key = F.struct((-F.ln(draw(F.col("d.doc_id"))) / weight).alias("_key"), F.col("d.doc_id").alias("doc_id"))
    quality = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
    return (
        docs.alias("d")
        .join(quality.alias("q"), F.col("d.doc_id") == F.col("q.doc_id"), "left")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(
            "d.*",
            *(F.col(f"p.{name}") for name in keep),
            (F.col("p.epochs") + F.when(key <= F.col("p.last"), 1).otherwise(0)).alias(copies),
        )
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents marked good count double, marked bad half; unmarked ones 1."""
    return labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight")
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"))


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``copies`` of every row."""
    quality = quality_weights(labels)
    narrow = stored(spark, sized(docs), "mix-sizes")
    plan = plan_mix(spark, narrow, quality)
    return apply_mix(narrow, quality, plan, "copies", ["source_size", "target"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def take(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of the mix with their columns and ``mix_copies``, how often each is taken."""
    quality = quality_weights(labels)
    plan = plan_mix(spark, sized(docs), quality)
    names = [c for c in docs.columns if c != "mix_copies"]
    return apply_mix(docs.select(*names), quality, plan, "mix_copies", []).where("mix_copies > 0")
