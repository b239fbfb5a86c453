"""Streams joined with small static tables: delivery by zone and month speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetspeed.operators import monitoring


def deliver_updates(updates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Updates per subscriber; ``subscriptions`` is static."""
    return monitoring.updates_per_subscriber(updates, subscriptions)


def deliver_alerts(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return monitoring.alerts_per_subscriber(alerts, subscriptions)


def enriched_updates(updates: DataFrame, reports: DataFrame, fallback_month: str) -> DataFrame:
    """Updates with the month speed of their line; ``reports`` is static."""
    return monitoring.with_month_speed(updates, reports, fallback_month)


def write_deliveries(
    delivered: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """One directory per subscriber; without a trigger runs over what has landed, then stops."""
    return (
        delivered.writeStream.format("parquet")
        .partitionBy("subscriber")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
