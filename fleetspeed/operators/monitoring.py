"""Real-time rules in batch form; the streaming module reuses the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspeed.functions import geo
from fleetspeed.functions.timekeys import inferred_month, iso_text, whole_seconds_between
from fleetspeed.operators.arrival import prior_max
from fleetspeed.schema import (
    ALERT_PRIORITY,
    ALERT_TEXT_PREFIX,
    ALL_ZONES,
    CRITICAL,
    DEFAULT_ALERT_LAT,
    DEFAULT_ALERT_LON,
    DEFAULT_ZONE,
    EN_ROUTE,
    EXCEPTIONAL,
    NO_SIGNAL,
    OK,
    ROUTINE,
    ROUTINE_EVENT_TYPES,
    STOPPED,
    Limits,
)

EVERYONE = -1  # delivery key of rows that go to every subscriber


def is_exceptional() -> Column:
    return ~F.col("event_type").isin(*ROUTINE_EVENT_TYPES)


def event_category() -> Column:
    return F.when(is_exceptional(), F.lit(EXCEPTIONAL)).otherwise(F.lit(ROUTINE))


def consumable(datagrams: DataFrame) -> DataFrame:
    """Without empty records (no date, or bus id 0)."""
    return datagrams.where(F.col("ts").isNotNull() & (F.col("bus_id") != 0))


def state_label(odometer: Column, previous_routine_odometer: Column) -> Column:
    return (
        F.when(is_exceptional(), F.lit(CRITICAL))
        .when(odometer == previous_routine_odometer, F.lit(STOPPED))
        .otherwise(F.lit(EN_ROUTE))
    )


def operational_state(datagrams: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``operational_state``: critical events do not touch the remembered odometer."""
    with_prior = prior_max(
        datagrams, ["bus_id"], ["seq"], ["seq"], ["odometer"], "_routine", limits.slice_rows, ~is_exceptional()
    )
    label = state_label(F.col("odometer"), F.col("_routine.odometer"))
    return with_prior.withColumn("operational_state", label).drop("_routine")


def with_line_zone(df: DataFrame, line_zones: DataFrame) -> DataFrame:
    """Add ``zone_id`` of the line; lines without one are in the default zone."""
    return df.join(line_zones.select("line_id", "zone_id"), "line_id", "left").withColumn(
        "zone_id", F.coalesce("zone_id", F.lit(DEFAULT_ZONE))
    )


def with_user_zone(users: DataFrame, user_zones: DataFrame) -> DataFrame:
    return users.join(user_zones.select("user_id", "zone_id"), "user_id", "left").withColumn(
        "zone_id", F.coalesce("zone_id", F.lit(DEFAULT_ZONE))
    )


def update_columns() -> list[Column]:
    """Projection of a datagram with zone and state to a bus update."""
    return [
        F.col("seq"),
        F.col("bus_id"),
        geo.degrees_of(F.col("raw_lat")).alias("lat"),
        geo.degrees_of(F.col("raw_lon")).alias("lon"),
        F.col("line_id"),
        F.col("ts"),
        iso_text(F.col("ts")).alias("ts_text"),
        F.col("zone_id"),
        F.col("operational_state"),
    ]


def bus_updates(datagrams: DataFrame, line_zones: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One update per consumed datagram."""
    stated = operational_state(consumable(datagrams), limits)
    return with_line_zone(stated, line_zones).select(*update_columns())


def critical_alerts(zoned: DataFrame) -> DataFrame:
    """One alert per exceptional datagram; needs ``zone_id``."""
    return zoned.where(is_exceptional()).select(
        "seq",
        "bus_id",
        "line_id",
        "zone_id",
        "event_type",
        F.lit(ALERT_PRIORITY).alias("priority"),
        "ts",
        F.concat(F.lit(ALERT_TEXT_PREFIX), F.col("event_type").cast("string")).alias("description"),
    )


def signal_gaps(datagrams: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Silences longer than the limit between consecutive arrivals of a bus."""
    rows = datagrams.select("bus_id", "seq", "ts")
    paired = prior_max(rows, ["bus_id"], ["seq"], ["seq"], ["ts"], "_prev", limits.slice_rows)
    silent = whole_seconds_between(F.col("_prev.ts"), F.col("ts"))
    return paired.select(
        "bus_id", "seq", F.col("_prev.ts").alias("last_ts"), "ts", silent.alias("silent_s")
    ).where(F.col("silent_s") > limits.signal_s)


def latest_per_bus(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns of the last arrival of every bus; partial results are merged.

    Columns of fixed width are aggregated by hash, without sorting the rows.
    """
    return df.groupBy("bus_id").agg(
        F.max("seq").alias("_seq"), *[F.max_by(c, "seq").alias(c) for c in columns]
    ).select("bus_id", F.col("_seq").alias("seq"), *columns)


def signal_lost_as_of(datagrams: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Per bus: seconds since the last arrival and whether the signal counts as lost."""
    silent = whole_seconds_between(F.col("ts"), now)
    return latest_per_bus(datagrams, "ts").select(
        "bus_id",
        F.col("ts").alias("last_ts"),
        silent.alias("silent_s"),
        (silent > limits.signal_s).alias("signal_lost"),
    )


def latest_bus_state(updates: DataFrame) -> DataFrame:
    return latest_per_bus(updates, "line_id", "lat", "lon", "ts", "zone_id", "operational_state")


def fleet_status(updates: DataFrame) -> DataFrame:
    """Buses per current state."""
    return (
        latest_per_bus(updates, "operational_state")
        .groupBy("operational_state")
        .agg(F.count(F.lit(1)).alias("buses"))
    )


def bus_board(updates: DataFrame) -> DataFrame:
    """Per bus: current state and alerts raised (every critical update raised one)."""
    return updates.groupBy("bus_id").agg(
        F.max(F.struct("seq", "operational_state")).alias("last"),
        F.count_if(F.col("operational_state") == CRITICAL).alias("alerts"),
    )


def board_totals(per_bus: DataFrame) -> DataFrame:
    """One row: buses seen, buses per state, alerts raised so far."""
    state = F.col("last.operational_state")
    return per_bus.agg(
        F.count(F.lit(1)).alias("buses"),
        F.count_if(state == EN_ROUTE).alias("en_route"),
        F.count_if(state == STOPPED).alias("stopped"),
        F.count_if(state == NO_SIGNAL).alias("no_signal"),
        F.count_if(state == CRITICAL).alias("critical"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
    )


def status_board(updates: DataFrame) -> DataFrame:
    return board_totals(bus_board(updates))


def alert_history(alerts: DataFrame, rows: int = 50) -> DataFrame:
    """The most recent alerts, newest first."""
    return alerts.orderBy(F.desc("seq")).limit(rows)


def delivery_map(subscriptions: DataFrame, with_everyone: bool) -> DataFrame:
    """``(subscriber, delivery_key)`` rows that reach every subscriber at most once.

    A subscriber of all zones keeps only that key; one of single zones keeps each of them.
    With ``with_everyone`` each subscriber is also listed under the broadcast key.
    """
    pairs = subscriptions.select("subscriber", "zone_id").distinct()
    wide = pairs.where(F.col("zone_id") == ALL_ZONES)
    narrow = pairs.join(wide.select("subscriber"), "subscriber", "left_anti")
    keyed = wide.unionByName(narrow).select("subscriber", F.col("zone_id").alias("delivery_key"))
    if not with_everyone:
        return keyed
    everyone = pairs.select("subscriber").distinct().withColumn("delivery_key", F.lit(EVERYONE))
    return keyed.unionByName(everyone)


def _deliver(rows: DataFrame, keys: Column, deliveries: DataFrame) -> DataFrame:
    """Equi-join on the delivery key; no pair that is not delivered is ever made.

    The subscriptions side is broadcast by the planner while its size allows; beyond that
    adaptive execution splits the crowded keys.
    """
    keyed = rows.withColumn("delivery_key", F.explode(keys))
    return keyed.join(deliveries, "delivery_key").drop("delivery_key")


def _zone_keys() -> Column:
    return F.array_distinct(F.array(F.lit(ALL_ZONES), F.col("zone_id")))


def updates_per_subscriber(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every update for every subscriber of its zone or of all zones, once each."""
    return _deliver(updates, _zone_keys(), delivery_map(subscriptions, with_everyone=False))


def alerts_per_subscriber(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """As for updates, but top-priority alerts reach every subscriber."""
    keys = F.when(F.col("priority") == ALERT_PRIORITY, F.array(F.lit(EVERYONE))).otherwise(_zone_keys())
    return _deliver(alerts, keys, delivery_map(subscriptions, with_everyone=True))


def delivery_counts(updates: DataFrame, alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Updates and alerts delivered per subscriber.

    Rows are counted per delivery key first; only the counts meet the subscriptions.
    """
    per_key = (
        updates.withColumn("delivery_key", F.explode(_zone_keys()))
        .groupBy("delivery_key")
        .agg(F.count(F.lit(1)).alias("updates"), F.lit(0).cast("bigint").alias("alerts"))
    )
    top = F.col("priority") == ALERT_PRIORITY
    alert_keys = F.when(top, F.array(F.lit(EVERYONE))).otherwise(_zone_keys())
    per_alert_key = (
        alerts.withColumn("delivery_key", F.explode(alert_keys))
        .groupBy("delivery_key")
        .agg(F.lit(0).cast("bigint").alias("updates"), F.count(F.lit(1)).alias("alerts"))
    )
    counts = per_key.unionByName(per_alert_key)
    return (
        delivery_map(subscriptions, with_everyone=True)
        .join(counts, "delivery_key", "left")
        .groupBy("subscriber")
        .agg(
            F.coalesce(F.sum("updates"), F.lit(0)).alias("updates"),
            F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
        )
    )


def current_subscriptions(changes: DataFrame) -> DataFrame:
    """``subscriber`` and ``zone_id`` by the latest version of each subscriber.

    ``changes`` has ``subscriber``, ``zones`` and ``version``; an empty list of zones ends a subscription.
    """
    latest = changes.groupBy("subscriber").agg(F.max_by("zones", "version").alias("zones"))
    return latest.select("subscriber", F.explode("zones").alias("zone_id"))


def zone_deliveries(updates: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row for each update or alert and delivery key, whoever listens: ``delivery_key``, ``kind`` and ``seq``.

    The table grows with what happens and not with the number of subscribers, who find their rows
    when they read (``inbox``).
    """
    top = F.col("priority") == ALERT_PRIORITY
    keys = F.when(top, F.array(F.lit(EVERYONE))).otherwise(F.array("zone_id"))
    told = alerts.select(F.explode(keys).alias("delivery_key"), F.lit("alert").alias("kind"), "seq")
    moved = updates.select(F.col("zone_id").alias("delivery_key"), F.lit("update").alias("kind"), "seq")
    return moved.unionByName(told)


def _listens(zone_id: Column) -> Column:
    """Delivery keys that a subscription of a zone reads; a key other than the zone itself is EVERYONE."""
    return F.array(zone_id, F.lit(EVERYONE))


def inbox(deliveries: DataFrame, subscriptions: DataFrame, subscriber: str) -> DataFrame:
    """What one subscriber gets, each update or alert once, as each has one key: a filter by the keys they listen to."""
    # A few zones at most: as many as there are zones.
    zones = {r["zone_id"] for r in subscriptions.where(F.col("subscriber") == subscriber).select("zone_id").distinct().collect()}
    if ALL_ZONES not in zones:
        deliveries = deliveries.where(F.col("delivery_key").isin(*zones, EVERYONE) if zones else F.lit(False))
    return deliveries.select("kind", "seq")


def inbox_counts(deliveries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``subscriber``, ``updates`` and ``alerts``: deliveries are counted by key before subscribers come in."""
    per_key = deliveries.groupBy("delivery_key").agg(
        F.count_if(F.col("kind") == "update").alias("updates"), F.count_if(F.col("kind") == "alert").alias("alerts")
    )
    total = per_key.agg(F.sum("updates").alias("updates"), F.sum("alerts").alias("alerts"))
    pairs = subscriptions.select("subscriber", "zone_id").distinct()
    wide = pairs.where(F.col("zone_id") == ALL_ZONES).select("subscriber")
    narrow = pairs.join(wide, "subscriber", "left_anti")
    keys = narrow.select("subscriber", F.explode(_listens(F.col("zone_id"))).alias("delivery_key")).distinct()
    zero = F.lit(0).cast("long")
    by_key = (
        keys.join(per_key, "delivery_key", "left")
        .groupBy("subscriber")
        .agg(F.coalesce(F.sum("updates"), zero).alias("updates"), F.coalesce(F.sum("alerts"), zero).alias("alerts"))
    )
    counted = total.select(F.struct(*[F.coalesce(c, zero).alias(c) for c in ("updates", "alerts")]).alias("t")).scalar()
    whole = wide.select("subscriber", counted["updates"].alias("updates"), counted["alerts"].alias("alerts"))
    return by_key.unionByName(whole)


def with_month_speed(updates: DataFrame, reports: DataFrame, fallback_month: str) -> DataFrame:
    """Add the average speed of the update's line and month; NULL without an OK report.

    The month comes from the update's timestamp text, or is the fallback when unreadable.
    """
    speeds = reports.where(F.col("status") == OK).select(
        "line_id", "year_month", F.col("average_speed_kmh").alias("line_speed_kmh")
    )
    return updates.withColumn("year_month", inferred_month(F.col("ts_text"), fallback_month)).join(
        speeds, ["line_id", "year_month"], "left"
    )


def alerts_with_position(alerts: DataFrame, updates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add the bus position known when the alert arrived, or the default one.

    An alert is sent after the update of the same datagram, so the update with the same
    sequence number counts as known.
    """
    shared = ["bus_id", "seq"]
    moves = updates.select(*shared, "lat", "lon", F.lit(0).alias("_kind"))
    asks = alerts.select(
        *shared,
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.lit(1).alias("_kind"),
        F.struct(*[c for c in alerts.columns if c not in shared]).alias("_alert"),
    )
    both = moves.unionByName(asks, allowMissingColumns=True)
    known = F.col("_kind") == 0
    placed = prior_max(
        both, ["bus_id"], ["seq", "_kind"], ["seq"], ["lat", "lon"], "_pos", limits.slice_rows, known
    )
    return placed.where(F.col("_kind") == 1).select(
        *shared,
        "_alert.*",
        F.coalesce("_pos.lat", F.lit(DEFAULT_ALERT_LAT)).alias("lat"),
        F.coalesce("_pos.lon", F.lit(DEFAULT_ALERT_LON)).alias("lon"),
    )


def map_filter(
    states: DataFrame,
    lines: list[int] | None = None,
    zone_id: int | None = None,
    first_ts: str | None = None,
    last_ts: str | None = None,
) -> DataFrame:
    """Live-map filter by line set, zone and time range; every part is optional."""
    if lines is not None:
        states = states.where(F.col("line_id").isin(*lines))
    if zone_id is not None:
        states = states.where(F.col("zone_id") == zone_id)
    if first_ts is not None:
        states = states.where(F.col("ts") >= F.lit(first_ts).cast("timestamp_ntz"))
    if last_ts is not None:
        states = states.where(F.col("ts") <= F.lit(last_ts).cast("timestamp_ntz"))
    return states


def bus_detail(updates: DataFrame, bus_id: int) -> DataFrame:
    """Line, last report, position and state of one bus."""
    return latest_bus_state(updates.where(F.col("bus_id") == bus_id))
