from __future__ import annotations

import os
import sys

import pytest
from conftest import SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

# A sample over all modules; tools/compare.py runs all of them.
CHECKED = (
    "route_month_speed",
    "route_month_speed_sorted",
    "route_month_speed_arrival",
    "rejects_by_reason",
    "csv_parse_roundtrip",
    "report_upsert",
    "bus_updates",
    "alert_last_position",
    "subscription_fanout",
    "lake_range_report",
    "lake_two_loads",
    "stream_signal_loss_replay",
)


def test_every_fleet_query_has_a_twin():
    from fleetcheck import oracle, queries

    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    report = entry.entry(spark)
    assert report.count() == 50 and "average_speed_kmh" in report.columns


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, connection, name):
    assert compare.compare(spark, connection, SMALL, name) == ""
