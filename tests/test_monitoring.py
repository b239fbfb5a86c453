from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import SMALL, datagram
from pyspark.sql import functions as F

from fleetcheck import inputs
from fleetspeed import Limits
from fleetspeed.operators import monitoring
from fleetspeed.plans.live import live_views

T0 = datetime(2019, 5, 27, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([(207, 1), (219, 2)], "line_id int, zone_id int")


@pytest.fixture(scope="module")
def subscriptions(spark):
    rows = [("all", 0), ("all", 1), ("one", 1), ("one", 2), ("two", 2), ("two", 2)]
    return spark.createDataFrame(rows, "subscriber string, zone_id int")


@pytest.fixture(scope="module")
def reports_of_buses(frame):
    return frame(
        [
            datagram(1, 207, 1, at(0), 34000000, -765000000, 10, 0, 100),
            datagram(2, 207, 1, at(30), 34000001, -765000000, 10, 1, 100),  # same odometer
            datagram(3, 207, 1, at(60), 34000002, -765000000, 10, 50, 100),  # critical
            datagram(4, 207, 1, at(90), 34000003, -765000000, 10, 2, 100),  # still the same
            datagram(5, 207, 1, at(151), 34000004, -765000000, 10, 0, 101),
            datagram(6, 219, 1, at(0), 34000005, -765000000, 11, 50, 5),
            datagram(7, 219, 1, at(61), 34000006, -765000000, 11, 0, 5),  # first routine one
            datagram(8, 233, 1, at(61), 34000007, -765000000, 12, 0, 5),
            datagram(9, 233, 1, at(61), 34000007, -765000000, 0, 0, 5),  # empty record
        ]
    )


STATES = {1: "EN_RUTA", 2: "PARADO", 3: "CRITICO", 4: "PARADO", 5: "EN_RUTA", 6: "CRITICO", 7: "EN_RUTA", 8: "EN_RUTA"}


@pytest.mark.parametrize("slice_rows", [None, 1, 2, 500])
def test_operational_state(reports_of_buses, slice_rows):
    rows = monitoring.consumable(reports_of_buses)
    found = monitoring.operational_state(rows, Limits(slice_rows=slice_rows)).collect()
    assert {r["seq"]: r["operational_state"] for r in found} == STATES


@pytest.mark.parametrize("slice_rows", [None, 2])
def test_signal_gaps(reports_of_buses, slice_rows):
    rows = monitoring.signal_gaps(monitoring.consumable(reports_of_buses), Limits(slice_rows=slice_rows))
    assert {(r["bus_id"], r["seq"], r["silent_s"]) for r in rows.collect()} == {(10, 5, 61), (11, 7, 61)}


def test_signal_lost_as_of(reports_of_buses):
    def lost(seconds):
        now = F.lit(str(at(seconds))).cast("timestamp_ntz")
        rows = monitoring.signal_lost_as_of(monitoring.consumable(reports_of_buses), now).collect()
        return {r["bus_id"] for r in rows if r["signal_lost"]}

    assert lost(121) == set()
    assert lost(122) == {11, 12}
    assert lost(212) == {10, 11, 12}


def test_updates_alerts_and_board(reports_of_buses, zones, subscriptions):
    views = live_views(reports_of_buses, zones, subscriptions)
    updates = {r["seq"]: r for r in views.updates.collect()}
    assert len(updates) == 8
    assert (updates[1]["zone_id"], updates[6]["zone_id"], updates[8]["zone_id"]) == (1, 2, 0)
    assert updates[1]["lat"] == pytest.approx(3.4) and updates[1]["ts_text"] == "2019-05-27T10:00"
    alerts = {r["seq"]: r for r in views.alerts.collect()}
    assert set(alerts) == {3, 6}
    assert (alerts[3]["priority"], alerts[3]["description"]) == ("ALTA", "Excepcional eventType=50")
    board = views.board.first()
    assert (board["buses"], board["en_route"], board["stopped"], board["critical"], board["alerts"]) == (3, 3, 0, 0, 2)
    assert {r["operational_state"]: r["buses"] for r in monitoring.fleet_status(views.updates).collect()} == {"EN_RUTA": 3}

    got = sorted((r["subscriber"], r["seq"]) for r in views.delivered_updates.collect())
    zone_one, zone_two = [1, 2, 3, 4, 5], [6, 7]
    expected = [("all", s) for s in range(1, 9)] + [("one", s) for s in zone_one + zone_two] + [("two", s) for s in zone_two]
    assert got == sorted(expected)
    got = sorted((r["subscriber"], r["seq"]) for r in views.delivered_alerts.collect())
    assert got == [(s, n) for s in ("all", "one", "two") for n in (3, 6)]

    counts = monitoring.delivery_counts(views.updates, views.alerts, subscriptions).collect()
    assert {tuple(r) for r in counts} == {("all", 8, 2), ("one", 7, 2), ("two", 2, 2)}


def test_low_priority_alerts_follow_zones(reports_of_buses, zones, subscriptions):
    zoned = monitoring.with_line_zone(reports_of_buses, zones)
    low = monitoring.critical_alerts(zoned).withColumn("priority", F.lit("BAJA"))
    got = sorted((r["subscriber"], r["seq"]) for r in monitoring.alerts_per_subscriber(low, subscriptions).collect())
    assert got == [("all", 3), ("all", 6), ("one", 3), ("one", 6), ("two", 6)]


def test_user_zone(spark):
    users = spark.createDataFrame([("ctrl-001",), ("other",)], "user_id string")
    known = spark.createDataFrame([("ctrl-001", 1)], "user_id string, zone_id int")
    assert {tuple(r) for r in monitoring.with_user_zone(users, known).collect()} == {("ctrl-001", 1), ("other", 0)}


def test_alert_history_keeps_fifty(spark):
    alerts = spark.range(60).select(F.col("id").alias("seq"))
    kept = [r["seq"] for r in monitoring.alert_history(alerts).collect()]
    assert kept == list(range(59, 9, -1))


@pytest.mark.parametrize("slice_rows", [None, 1, 3])
def test_alert_position(reports_of_buses, zones, slice_rows):
    updates = monitoring.bus_updates(reports_of_buses, zones)
    alerts = monitoring.critical_alerts(monitoring.with_line_zone(reports_of_buses, zones))
    known = updates.where("seq not in (3, 6)")
    limits = Limits(slice_rows=slice_rows)
    found = {r["seq"]: (r["lat"], r["lon"]) for r in monitoring.alerts_with_position(alerts, known, limits).collect()}
    assert found[3] == (pytest.approx(3.4000001), pytest.approx(-76.5))
    assert found[6] == (3.42, -76.52)
    found = {r["seq"]: r["lat"] for r in monitoring.alerts_with_position(alerts, updates, limits).collect()}
    assert found[3] == pytest.approx(3.4000002) and found[6] == pytest.approx(3.4000005)


def test_month_speed_only_from_ok_reports(spark, reports_of_buses, zones):
    reports = spark.createDataFrame(
        [(207, "2019-05", 17.5, "OK"), (219, "2019-05", 0.0, "NO_DATA"), (207, "2019-06", 9.0, "OK")],
        "line_id int, year_month string, average_speed_kmh double, status string",
    )
    rows = monitoring.with_month_speed(monitoring.bus_updates(reports_of_buses, zones), reports, "2018-01").collect()
    assert {(r["line_id"], r["line_speed_kmh"]) for r in rows} == {(207, 17.5), (219, None), (233, None)}
    broken = monitoring.bus_updates(reports_of_buses, zones).withColumn("ts_text", F.lit("?"))
    rows = monitoring.with_month_speed(broken, reports, "2019-06").collect()
    assert {(r["line_id"], r["line_speed_kmh"]) for r in rows} == {(207, 9.0), (219, None), (233, None)}


def test_map_filter_and_detail(reports_of_buses, zones):
    updates = monitoring.bus_updates(reports_of_buses, zones)
    assert monitoring.map_filter(updates).count() == 8
    assert monitoring.map_filter(updates, lines=[219, 233]).count() == 3
    assert monitoring.map_filter(updates, zone_id=1, first_ts=str(at(30)), last_ts=str(at(90))).count() == 3
    detail = monitoring.bus_detail(updates, 10).first()
    assert (detail["line_id"], detail["operational_state"]) == (207, "EN_RUTA")
    assert detail["ts"] == at(151)


@pytest.mark.parametrize("slice_rows", [3, 40])
def test_slices_on_derived_rows(spark, slice_rows):
    rows = monitoring.consumable(inputs.datagrams(spark, SMALL)).cache()
    limits = Limits(slice_rows=slice_rows)
    whole = Limits(slice_rows=None)
    for operator in (monitoring.operational_state, monitoring.signal_gaps):
        assert sorted(map(str, operator(rows, limits).collect())) == sorted(map(str, operator(rows, whole).collect()))
