"""Live vehicle streams: states, updates, alerts, silences, segments, board, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetspeed.functions import geo
from fleetspeed.functions.timekeys import epoch_micros
from fleetspeed.operators import monitoring
from fleetspeed.operators.metrics import stream_counters
from fleetspeed.operators.quality import valid_datagrams
from fleetspeed.operators.segments import located, with_segment
from fleetspeed.schema import TRIP_KEY, Limits
from fleetspeed.sinks.live import write_batch, write_updates_and_alerts
from fleetspeed.streaming.processors import OperationalState, SignalLoss, TripSegments

NOW = {"availableNow": True}  # run over what has landed, then stop


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(n, t) for n, t in fields])


def operational_state_stream(datagrams: DataFrame) -> DataFrame:
    """Streaming twin of ``monitoring.operational_state``."""
    return datagrams.groupBy("bus_id").transformWithStateInPandas(
        statefulProcessor=OperationalState(),
        outputStructType=_with(datagrams.schema, ("operational_state", T.StringType())),
        outputMode="Append",
        timeMode="None",
    )


def zoned_state_stream(datagrams: DataFrame, line_zones: DataFrame) -> DataFrame:
    """Consumable datagrams with state and zone; only the needed columns pass through Python."""
    needed = monitoring.consumable(datagrams).select(
        "seq", "bus_id", "line_id", "event_type", "odometer", "raw_lat", "raw_lon", "ts"
    )
    return monitoring.with_line_zone(operational_state_stream(needed), line_zones)


def bus_update_stream(datagrams: DataFrame, line_zones: DataFrame) -> DataFrame:
    return zoned_state_stream(datagrams, line_zones).select(*monitoring.update_columns())


def critical_alert_stream(datagrams: DataFrame, line_zones: DataFrame) -> DataFrame:
    """Stateless: alerts need no bus memory."""
    zoned = monitoring.with_line_zone(monitoring.consumable(datagrams), line_zones)
    return monitoring.critical_alerts(zoned)


def publish(
    datagrams: DataFrame, line_zones: DataFrame, updates: str, alerts: str, checkpoint: str, trigger: dict = NOW
) -> StreamingQuery:
    """Write updates and alerts from one query.

    Each micro-batch is written under its number and a repeated one replaces itself.
    """
    live = zoned_state_stream(datagrams, line_zones).select(*monitoring.update_columns(), "event_type")

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_updates_and_alerts(batch, batch_id, updates, alerts)

    return live.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def signal_loss_stream(datagrams: DataFrame, limits: Limits = Limits(), live: bool = True) -> DataFrame:
    """``(bus_id, last_ts, operational_state)``, one row per silence above the limit.

    No report is dropped, however late.  A ``live`` stream also tells silences that still last, by the
    clock; a replay runs faster than the clock and tells those that ended.
    """
    reports = datagrams.select("bus_id", "seq", epoch_micros(F.col("ts")).alias("ts_us"))
    out = T.StructType(
        [
            T.StructField("bus_id", T.IntegerType()),
            T.StructField("last_us", T.LongType()),
            T.StructField("operational_state", T.StringType()),
        ]
    )
    lost = reports.groupBy("bus_id").transformWithStateInPandas(
        statefulProcessor=SignalLoss(limits.signal_s, live),
        outputStructType=out,
        outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
    last_ts = F.timestamp_micros(F.col("last_us")).cast("timestamp_ntz")
    return lost.select("bus_id", last_ts.alias("last_ts"), "operational_state")


def trip_segment_stream(
    datagrams: DataFrame, routes: DataFrame, limits: Limits = Limits(), live: bool = False
) -> DataFrame:
    """Streaming twin of ``segments.trip_segments`` in the normative mode.

    A ``live`` stream forgets trips that have been silent for a day, by the clock; such a query runs on
    after all that has landed and so needs another trigger than ``NOW``.
    """
    rows = located(valid_datagrams(datagrams, routes))
    out = _with(
        rows.schema,
        ("late", T.BooleanType()),
        ("prev_ts_us", T.LongType()),
        ("prev_lat", T.DoubleType()),
        ("prev_lon", T.DoubleType()),
    )
    paired = rows.groupBy(*TRIP_KEY).transformWithStateInPandas(
        statefulProcessor=TripSegments(live),
        outputStructType=out,
        outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
    names = ("ts_us", "lat", "lon")
    prev = F.struct(*[F.col(f"prev_{n}").alias(n) for n in names])
    packed = paired.withColumn("prev", prev).drop(*[f"prev_{n}" for n in names])
    return with_segment(packed, F.col("late"), geo.segment_ok, limits)


def publish_board(updates: DataFrame, target: str, checkpoint: str, trigger: dict = NOW) -> StreamingQuery:
    """Keep the status board current: one row after every micro-batch, under its number.

    Nothing is deleted, so a reader finds a whole board at any time (``read_board``).
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(monitoring.board_totals(batch), target, batch_id)

    board = monitoring.bus_board(updates).writeStream.outputMode("complete").foreachBatch(sink)
    return board.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_board(spark: SparkSession, target: str) -> DataFrame:
    """The board of the newest micro-batch."""
    return spark.read.parquet(target).orderBy(F.desc("batch_id")).limit(1).drop("batch_id")


def throttled_alerts(alerts: DataFrame, window: str = "5 seconds") -> DataFrame:
    """Alerts per bus and tumbling window: their number and the first of them, of a batch or a stream.

    A stream keeps every window, so an alert counts however late it comes; write it with
    ``publish_throttled``.
    """
    return (
        alerts.groupBy("bus_id", F.window(F.col("ts").cast("timestamp"), window).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.min("seq").alias("first_seq"),
            F.min_by("description", "seq").alias("description"),
        )
        .select(
            "bus_id",
            F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
            "alerts",
            "first_seq",
            "description",
        )
    )


def publish_throttled(
    alerts: DataFrame, target: str, checkpoint: str, window: str = "5 seconds", trigger: dict = NOW
) -> StreamingQuery:
    """Write the windows that a micro-batch has changed, under its number."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, target, batch_id)

    changed = throttled_alerts(alerts, window).writeStream.outputMode("update").foreachBatch(sink)
    return changed.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_throttled(spark: SparkSession, target: str) -> DataFrame:
    """Every window as its last micro-batch left it."""
    columns = ("alerts", "first_seq", "description")
    newest = F.max(F.struct("batch_id", *columns)).alias("last")
    found = spark.read.parquet(target).groupBy("bus_id", "window_start").agg(newest)
    return found.select("bus_id", "window_start", *(F.col(f"last.{c}").alias(c) for c in columns))


def deduplicated(datagrams: DataFrame) -> DataFrame:
    """Drop repeats of a report that a source may deliver again after a failure.

    Reports are remembered in the state store on disk, without a limit in time: a late report is
    never taken for a repeat.
    """
    return datagrams.dropDuplicates(["bus_id", "ts", "trip_id"])


def publish_counters(datagrams: DataFrame, target: str, checkpoint: str, trigger: dict = NOW) -> StreamingQuery:
    """One row of counters per micro-batch; their sum is the state of the consumer."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(stream_counters(batch), target, batch_id)

    return datagrams.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
