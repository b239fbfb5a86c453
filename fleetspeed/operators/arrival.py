"""Ordered state per key that also holds when one key owns a large share of the rows.

A running window needs all rows of its key in one task.  Trips are short, but a broken
vehicle id can own a third of the table, and windows per bus grow with the history.
So keys above a row limit are cut into consecutive slices: every slice is windowed on its
own and starts from the state that the earlier slices ended with.  That works because the
state is a maximum, which can be taken per slice first and then over the slice results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspeed.operators.ranks import ranked

SLICE = "_slice"

# At most this many keys are sliced, the largest ones.  A key left out is smaller than all of
# them, so it holds less than one part in SLICED_KEYS of the rows and fits in one task.
# This bounds the broadcast list at a few megabytes whatever the size of the input.
SLICED_KEYS = 100_000


def crowded_keys(df: DataFrame, keys: Sequence[str], slice_rows: int) -> DataFrame | None:
    """The keys with more than ``slice_rows`` rows, counted now; none if there are none.

    The list has at most ``SLICED_KEYS`` rows, so it may pass through the driver.
    """
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > slice_rows)
        .orderBy(F.desc("_n"))
        .limit(SLICED_KEYS)
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.lit(True).alias("_cut"))
    )
    rows = found.collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, found.schema)) if rows else None


def _of_crowded(df: DataFrame, crowded: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows joined with the list of crowded keys; a null key is a key."""
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return df.join(crowded, same, how).drop(*[f"_key_{k}" for k in keys])


def with_slices(df: DataFrame, crowded: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int) -> DataFrame:
    """Add the number of the slice of a row, 0 for keys that are not crowded, and ``_cut``.

    Sequence numbers are unique, so a slice of ``slice_rows`` numbers never has more rows than that,
    wherever the rows of a key lie.  In any other order a slice is cut by the exact rank of
    its rows, so ties, nulls and crowded hours do not make it larger.
    """
    marked = _of_crowded(df, crowded, keys, "left")
    if order[0] == "seq":
        return marked.withColumn(SLICE, F.when(F.col("_cut"), F.floor(F.col("seq") / slice_rows)).otherwise(0))
    plain = marked.where(F.col("_cut").isNull()).withColumn(SLICE, F.lit(0).cast("long"))
    large = ranked(df.sparkSession, marked.where(F.col("_cut")), keys, [F.col(c) for c in order], "_rank")
    cut = large.withColumn(SLICE, F.floor(F.col("_rank") / slice_rows).cast("long")).drop("_rank")
    return plain.unionByName(cut)


def _slice_ends(rows: DataFrame, by: Sequence[Column | str], rank: list[str], carry: list[str]) -> DataFrame:
    """Highest-ranked row per group as a struct."""
    if len(rank) > 1:
        return rows.groupBy(*by).agg(F.max(F.struct(*rank, *carry)).alias("_end"))
    # With a single rank all buffers have a fixed width, so partial results are hashed and
    # the rows need no sort.
    top = rank[0]
    found = rows.groupBy(*by).agg(
        F.max(top).alias("_top"), *[F.max_by(c, top).alias(f"_top_{c}") for c in carry]
    )
    names = [c if isinstance(c, str) else SLICE for c in by]
    return found.select(
        *names,
        F.struct(F.col("_top").alias(top), *[F.col(f"_top_{c}").alias(c) for c in carry]).alias("_end"),
    )


def prior_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rank: Sequence[str],
    carry: Sequence[str],
    into: str,
    slice_rows: int | None,
    counts: Column | None = None,
) -> DataFrame:
    """Add ``into``: the highest-ranked row among the strictly earlier rows of the same key.

    ``order`` is a total order within a key; crowded keys are sliced along it.  ``rank`` columns, ``carry`` columns and the result are kept as one struct; where
    ``counts`` is false a row is not a candidate.  The result is NULL without a candidate.
    """
    keys, order, rank, carry = list(keys), list(order), list(rank), list(carry)
    columns = df.columns
    # The shuffle carries the state as one struct instead of its columns and a copy of them.
    df = df.withColumn("_state", F.struct(*rank, *carry))
    packed = [c for c in (*rank, *carry) if c not in (*keys, *order)] if counts is None else []
    candidate = F.col("_state") if counts is None else F.when(counts, F.col("_state"))

    def unpacked(result: DataFrame) -> DataFrame:
        return result.select(
            *[F.col("_state")[c].alias(c) if c in packed else F.col(c) for c in columns], into
        )

    def highest_before(*by: str) -> Column:
        window = Window.partitionBy(*by).orderBy(*order)
        return F.max(candidate).over(window.rowsBetween(Window.unboundedPreceding, -1))

    if slice_rows is None:
        return unpacked(df.drop(*packed).withColumn(into, highest_before(*keys)))

    crowded = crowded_keys(df, keys, slice_rows)
    if crowded is None:
        return unpacked(df.drop(*packed).withColumn(into, highest_before(*keys)))
    sliced = with_slices(df, crowded, keys, order, slice_rows)

    # The state every slice of a crowded key starts from.
    large = sliced.where(F.col("_cut"))
    candidates = large if counts is None else large.where(counts)
    ends = _slice_ends(candidates, [*keys, F.col(SLICE)], rank, carry)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, SLICE]
    # A slice without candidates has no end of its own but still needs a start.
    every = large.select(*names).distinct()
    starts = (
        _null_safe(every, ends, names)
        .withColumn("_start", F.max("_end").over(earlier))
        .where(F.col("_start").isNotNull())
        .drop("_end")
    )
    started = _null_safe(sliced.drop(*packed, "_cut"), starts, names)
    return unpacked(started.withColumn(into, F.greatest(F.col("_start"), highest_before(*keys, SLICE))))


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on equal names, where nulls are equal."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    same = F.lit(True)
    for name in names:
        same &= F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    return left.join(other, same, "left").drop(*[f"_r_{n}" for n in names])
