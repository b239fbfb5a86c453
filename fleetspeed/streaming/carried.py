"""Streams whose state is carried over micro-batches as rows.

The state of a bus or trip is one report: the last routine one, the last one, the newest accepted one.  Each
micro-batch is put behind these reports and goes through the batch operator, in JVM windows that cut a
crowded key into slices, so no key is bound to one task and no row passes through Python.  Then the
reports that the next micro-batch needs are kept.

State is a table of two slots.  Micro-batch N reads the slot of N - 1 and overwrites its own, and its outputs
stand under its number, so a repeated micro-batch replaces itself.  Every micro-batch rewrites the reports of all
keys, so their number should stay small beside it: ``keep_s`` lets silent trips go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetspeed.functions import geo
from fleetspeed.functions.timekeys import epoch_micros
from fleetspeed.operators import monitoring
from fleetspeed.operators.arrival import prior_max
from fleetspeed.operators.quality import valid_datagrams
from fleetspeed.operators.segments import located, with_segment
from fleetspeed.schema import TRIP_KEY, Limits
from fleetspeed.sinks.live import write_batch

NOW = {"availableNow": True}  # run over what has landed, then stop

# Carried rows count as earlier than all rows of the micro-batch.
EARLIER = -(1 << 62)
SECOND_US = 1_000_000


def _carried(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows that the micro-batch before this one kept, numbered as the earliest."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    kept = spark.read.schema(T.StructType(schema.fields + [T.StructField("_batch", T.LongType())]))
    kept = kept.parquet(f"{folder}/slot={(batch_id - 1) % 2}")
    if kept.where(F.col("_batch") != batch_id - 1).limit(1).count():
        raise RuntimeError(f"{folder} does not hold the state before micro-batch {batch_id}")
    return kept.drop("_batch").withColumn("seq", F.lit(EARLIER).cast("long"))


def _keep(rows: DataFrame, folder: str, batch_id: int) -> None:
    numbered = rows.withColumn("_batch", F.lit(batch_id).cast("long"))
    numbered.write.mode("overwrite").parquet(f"{folder}/slot={batch_id % 2}")


def _newest(rows: DataFrame, keys: tuple[str, ...], rank: tuple[str, ...]) -> DataFrame:
    """The highest-ranked row of each key, from partial maxima."""
    rest = [c for c in rows.columns if c not in (*keys, *rank)]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*rank, *rest)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in rows.columns])


Step = Callable[[DataFrame, int, Callable[[DataFrame], None]], None]


def _run(rows: DataFrame, state: str, checkpoint: str, step: Step, trigger: dict) -> StreamingQuery:
    """Start a query; ``step`` writes the outputs of carried and new rows and hands over what to keep."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        carried = _carried(batch.sparkSession, state, batch_id, batch.schema)
        together = carried.unionByName(batch).persist()
        try:
            step(together, batch_id, lambda kept: _keep(kept, state, batch_id))
        finally:
            together.unpersist()

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _recent(rows: DataFrame, micros: str, seconds: int, of: str | None = None) -> DataFrame:
    """Rows of which ``micros`` is at most so much older than the newest ``of`` (else ``micros``) of their bus."""
    ends = rows.groupBy(F.col("bus_id").alias("_bus")).agg(F.max(of or micros).alias("_end"))
    # Merged, as a broadcast side would pass through the driver in every micro-batch.
    joined = rows.hint("merge").join(ends.hint("merge"), F.col("bus_id").eqNullSafe(F.col("_bus")))
    return joined.where(F.col(micros) >= F.col("_end") - seconds * SECOND_US).select(*rows.columns)


def _new(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("seq") != EARLIER)


def publish_states(
    datagrams: DataFrame,
    line_zones: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    limits: Limits = Limits(),
    trigger: dict = NOW,
) -> StreamingQuery:
    """Bus updates with operational state and zone; a bus carries its last routine report."""
    columns = ("seq", "bus_id", "line_id", "event_type", "odometer", "raw_lat", "raw_lon", "ts")

    def step(rows: DataFrame, batch_id: int, keep: Callable[[DataFrame], None]) -> None:
        told = _new(monitoring.operational_state(rows, limits))
        updates = monitoring.with_line_zone(told, line_zones).select(*monitoring.update_columns())
        write_batch(updates, target, batch_id)
        keep(_newest(rows.where(~monitoring.is_exceptional()), ("bus_id",), ("seq",)))

    return _run(monitoring.consumable(datagrams).select(*columns), state, checkpoint, step, trigger)


def publish_silences(
    datagrams: DataFrame, target: str, state: str, checkpoint: str, limits: Limits = Limits(), trigger: dict = NOW
) -> StreamingQuery:
    """Silences of buses that have ended; a bus carries its last report."""

    def step(rows: DataFrame, batch_id: int, keep: Callable[[DataFrame], None]) -> None:
        write_batch(monitoring.signal_gaps(rows, limits), target, batch_id)
        keep(_newest(rows, ("bus_id",), ("seq",)))

    return _run(monitoring.consumable(datagrams).select("seq", "bus_id", "ts"), state, checkpoint, step, trigger)


def publish_segments(
    datagrams: DataFrame,
    routes: DataFrame,
    target: str,
    state: str,
    checkpoint: str,
    keep_s: int | None = None,
    limits: Limits = Limits(),
    trigger: dict = NOW,
) -> StreamingQuery:
    """Segments of trips in the normative mode; a trip carries its newest report.

    With ``keep_s`` a trip goes when its newest report is that much older than the newest one of its bus.  A later
    report of such a trip starts it anew.
    """

    def step(rows: DataFrame, batch_id: int, keep: Callable[[DataFrame], None]) -> None:
        first = rows.withColumn("first", -F.col("seq"))
        paired = prior_max(first, TRIP_KEY, ["seq"], ["ts_us", "first"], ["lat", "lon"], "prev", limits.slice_rows)
        late = F.coalesce(F.col("ts_us") <= F.col("prev.ts_us"), F.lit(False))
        write_batch(_new(with_segment(paired.drop("first"), late, geo.segment_ok, limits)), target, batch_id)
        newest = _newest(first, TRIP_KEY, ("ts_us", "first")).drop("first")
        keep(newest if keep_s is None else _recent(newest, "ts_us", keep_s))

    return _run(located(valid_datagrams(datagrams, routes)), state, checkpoint, step, trigger)


def publish_unrepeated(
    datagrams: DataFrame,
    target: str,
    aside: str,
    state: str,
    checkpoint: str,
    horizon_s: int,
    limits: Limits = Limits(),
    trigger: dict = NOW,
) -> StreamingQuery:
    """First arrivals of each report (bus, time, trip), with a state that does not grow with the history.

    A bus carries its reports of the last ``horizon_s`` seconds before its newest one.  A report older than that
    when it arrives can't be told from a repeat; such rows are neither kept nor lost but written to ``aside``.
    Both depend on the order of arrival only, not on how it is cut into micro-batches.
    """
    same, columns = ("bus_id", "ts", "trip_id"), datagrams.columns

    def step(rows: DataFrame, batch_id: int, keep: Callable[[DataFrame], None]) -> None:
        timed = rows.withColumn("_us", epoch_micros(F.col("ts")))
        carried = timed.where(F.col("seq") == EARLIER)
        # Of what a bus carries, its newest report alone tells which of the new ones are too old.
        ahead = _new(timed).unionByName(_newest(carried, ("bus_id",), ("_us",)))
        bounded = prior_max(ahead, ["bus_id"], ["seq"], ["_us"], [], "_newest", limits.slice_rows)
        old = F.coalesce(F.col("_us") < F.col("_newest._us") - horizon_s * SECOND_US, F.lit(False))
        judged = _new(bounded).withColumn("_old", old).drop("_newest").persist()
        try:
            write_batch(judged.where("_old").select(*columns), aside, batch_id)
            recent = judged.where(~F.col("_old")).drop("_old").unionByName(carried)
            # The first report of each as a whole, so that it need not be joined with its number.
            firsts = _newest(recent.withColumn("_first", -F.col("seq")), same, ("_first",))
            write_batch(_new(firsts).select(*columns), target, batch_id)
            # One report stands for its repeats.
            keep(_newest(_recent(recent, "_us", horizon_s).select(*columns), same, ("seq",)))
        finally:
            judged.unpersist()

    return _run(monitoring.consumable(datagrams), state, checkpoint, step, trigger)


def publish_throttled_within(
    alerts: DataFrame,
    target: str,
    aside: str,
    state: str,
    checkpoint: str,
    horizon_s: int,
    window: str = "5 seconds",
    limits: Limits = Limits(),
    trigger: dict = NOW,
) -> StreamingQuery:
    """Alert windows as in ``vehicles.publish_throttled``, with a state that does not grow with the history.

    A bus carries its alerts of the last ``horizon_s`` seconds and one window more, as one row a window.  An alert older than
    ``horizon_s`` before the newest one of its bus, when it arrives, counts in no window and is written to ``aside``.  Read the windows
    with ``vehicles.read_throttled``.
    """
    starts = F.window(F.col("ts").cast("timestamp"), window)
    told = ("alerts", "first_seq", "description")
    columns = alerts.columns
    one = alerts.withColumns(
        {
            "window_start": starts.start.cast("timestamp_ntz"),
            "window_end": starts.end.cast("timestamp_ntz"),
            "alerts": F.lit(1).cast("long"),
            "first_seq": F.col("seq"),
            "newest_us": epoch_micros(F.col("ts")),
        }
    )

    def step(rows: DataFrame, batch_id: int, keep: Callable[[DataFrame], None]) -> None:
        earlier = rows.where(F.col("seq") == EARLIER)
        ahead = _new(rows).unionByName(_newest(earlier, ("bus_id",), ("newest_us",)))
        bounded = prior_max(ahead, ["bus_id"], ["seq"], ["newest_us"], [], "_newest", limits.slice_rows)
        old = F.coalesce(F.col("newest_us") < F.col("_newest.newest_us") - horizon_s * SECOND_US, F.lit(False))
        judged = _new(bounded).withColumn("_old", old).drop("_newest").persist()
        try:
            write_batch(judged.where("_old").select(*columns), aside, batch_id)
            counted = judged.where(~F.col("_old")).drop("_old").unionByName(earlier)
            by = ("bus_id", "window_start", "window_end")
            windows = counted.groupBy(*by).agg(
                F.sum("alerts").alias("alerts"),
                F.min("first_seq").alias("first_seq"),
                F.min_by("description", "first_seq").alias("description"),
                F.max("newest_us").alias("newest_us"),
                (F.max("seq") != EARLIER).alias("_changed"),
                *[F.min_by(c, "first_seq").alias(c) for c in columns if c not in ("bus_id", "seq", "description")],
            )
            write_batch(windows.where("_changed").select("bus_id", "window_start", *told), target, batch_id)
            # A window stays while an alert in it could still be young enough.
            open_ = _recent(windows.withColumn("_until", epoch_micros(F.col("window_end"))), "_until", horizon_s, "newest_us")
            keep(open_.withColumn("seq", F.col("first_seq")).select(*rows.columns))
        finally:
            judged.unpersist()

    return _run(one, state, checkpoint, step, trigger)
