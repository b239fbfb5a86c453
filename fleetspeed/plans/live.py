"""Live monitoring over a batch of datagrams: updates, alerts, delivery and board at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fleetspeed.operators import monitoring
from fleetspeed.schema import Limits


@dataclass(frozen=True)
class LiveViews:
    updates: DataFrame
    alerts: DataFrame
    delivered_updates: DataFrame
    delivered_alerts: DataFrame
    board: DataFrame


def live_views(
    datagrams: DataFrame, line_zones: DataFrame, subscriptions: DataFrame, limits: Limits = Limits()
) -> LiveViews:
    updates = monitoring.bus_updates(datagrams, line_zones, limits)
    zoned = monitoring.with_line_zone(monitoring.consumable(datagrams), line_zones)
    alerts = monitoring.critical_alerts(zoned)
    return LiveViews(
        updates=updates,
        alerts=alerts,
        delivered_updates=monitoring.updates_per_subscriber(updates, subscriptions),
        delivered_alerts=monitoring.alerts_per_subscriber(alerts, subscriptions),
        board=monitoring.status_board(updates),
    )
