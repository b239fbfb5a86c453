"""What the planner makes of the main jobs."""

from __future__ import annotations

import pytest
from conftest import SMALL, datagram

from fleetcheck import inputs
from fleetspeed import Limits
from fleetspeed.operators import arrival, monitoring, quality, speed
from fleetspeed.operators.segments import trip_segments
from fleetspeed.plans.route_month import lake_totals, speed_report
from fleetspeed.schema import DATAGRAM_SCHEMA
from fleetspeed.sinks.lake import write_lake
from fleetspeed.sinks.report_store import ReportStore
from fleetspeed.sources import lake


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small_lake(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans") / "lake")
    write_lake(quality.valid_datagrams(inputs.datagrams(spark, SMALL), inputs.routes(spark, SMALL)), folder)
    return folder


def test_one_exchange_sort_and_window_per_segmentation(spark):
    valid = quality.valid_datagrams(inputs.datagrams(spark, SMALL), inputs.routes(spark, SMALL))
    plan = plan_of(speed.route_month_totals(trip_segments(valid, Limits(slice_rows=None))))
    assert plan.count("Window [") == 1
    assert plan.count("Sort [") == 1
    assert plan.count("Exchange hashpartitioning(trip_id") == 1
    assert plan.count("ATAN2") == 1  # the distance is computed once per row


def test_lake_scan_is_pruned_and_narrow(spark, small_lake):
    plan = plan_of(lake_totals(spark, small_lake, "2018-06", "2018-06", Limits(slice_rows=None), "arrival"))
    scan = plan[plan.index("FileScan parquet") :]
    assert "PartitionFilters: [isnotnull(" in scan or "PartitionFilters: [((" in scan
    read = scan[scan.index("ReadSchema") :].split("\n")[0]
    for name in ("odometer", "register_date", "unknown1", "event_type"):
        assert name not in read


@pytest.mark.parametrize("build", ["report", "fanout", "detail"])
def test_no_cross_joins_and_no_python(spark, build):
    events, catalogue = inputs.datagrams(spark, SMALL), inputs.routes(spark, SMALL)
    updates = monitoring.bus_updates(events, inputs.line_zones(spark, SMALL))
    df = {
        "report": lambda: speed_report(events, catalogue),
        "fanout": lambda: monitoring.updates_per_subscriber(updates, inputs.subscriptions(spark, SMALL)),
        "detail": lambda: monitoring.bus_detail(updates, 3),
    }[build]()
    plan = plan_of(df)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in plan


def test_crowded_keys_are_counted_once_and_bounded(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("if(id < 900, NULL, id % 10) AS k", "id AS seq")
    assert arrival.crowded_keys(rows, ["k"], 900) is None
    monkeypatch.setattr(arrival, "SLICED_KEYS", 1)
    assert [tuple(r) for r in arrival.crowded_keys(rows, ["k"], 5).collect()] == [(None, True)]


@pytest.mark.parametrize("order", [["seq"], ["t", "seq"]])
def test_no_slice_has_more_rows_than_the_limit(spark, order):
    """One key with most rows, in one hour with equal and null times."""
    rows = spark.range(5000).selectExpr("if(id < 4000, 7, id) AS k", "id AS seq", "if(id % 9 = 0, NULL, id % 3) AS t")
    crowded = arrival.crowded_keys(rows, ["k"], 100)
    sliced = arrival.with_slices(rows, crowded, ["k"], order, 100)
    sizes = sliced.where("k = 7").groupBy(arrival.SLICE).count().collect()
    assert max(r["count"] for r in sizes) <= 100 and sum(r["count"] for r in sizes) == 4000
    assert sliced.count() == 5000


def test_a_month_run_reads_the_months_of_its_trips(spark, tmp_path):
    """Only directories of months that share trips with the range are opened, and totals are the same."""
    at = lambda month, day: f"2019-{month:02d}-{day:02d} 10:00:00"
    rows = []
    for month in range(1, 7):
        rows += [datagram(10 * month + k, 207, month, at(month, k + 1), 34512000 + k, -765310000 + 900 * k, 42) for k in range(4)]
    # A trip of January goes on in March, and its late report arrives there.
    rows += [datagram(100, 207, 1, at(3, 9), 34512900, -765310000, 42), datagram(101, 207, 1, at(1, 9), 34512950, -765310100, 42)]
    folder = str(tmp_path / "lake")
    datagrams = spark.createDataFrame(rows, DATAGRAM_SCHEMA)
    write_lake(datagrams.where("seq <= 40"), folder, "bulk-0")
    write_lake(datagrams.where("seq > 40"), folder, "bulk-1")
    assert lake.months_of_trips(spark, folder, "2019-03", "2019-03") == [201901, 201903]
    assert lake.months_of_trips(spark, folder, "2019-05", "2019-05") == [201905]
    assert lake.months_of_trips(spark, folder, "2020-01", "2020-12") == []
    narrow = lake_totals(spark, folder, "2019-03", "2019-03")
    wide = speed.route_month_totals(trip_segments(lake.read_lake(spark, folder))).where("year_month = '2019-03'")
    assert [tuple(r) for r in narrow.collect()] == [tuple(r) for r in wide.collect()] != []
    opened = {f.split("month=")[1][:2] for f in lake.lake_of_months(spark, folder, [201901, 201903]).inputFiles()}
    assert len(opened) == 6  # listed, and pruned by the filter:
    plan = plan_of(lake.lake_of_months(spark, folder, [201901, 201903]))
    assert "PartitionFilters: [" in plan and "IN (201901,201903)" in plan
    # A load that has not noted its trips makes the run read all months.
    datagrams.where("seq > 40").selectExpr("*", "2019 AS year", "'06' AS month", "'old' AS load_id").write.mode("append").partitionBy(
        "line_id", "year", "month", "load_id"
    ).parquet(folder)
    assert lake.months_of_trips(spark, folder, "2019-05", "2019-05") is None


def test_stored_reports_are_read_by_month(spark, tmp_path):
    report = speed_report(inputs.datagrams(spark, SMALL), inputs.routes(spark, SMALL))
    store = ReportStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.owners() == {}
    first = store.replace_months(report)
    months = sorted(store.owners())
    found = store.in_range((2018, 6), (2018, 7))
    assert {f.split("year_month=")[1][:7] for f in found.inputFiles()} == {m for m in months if "2018-06" <= m <= "2018-07"}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, report.where("year_month between '2018-06' and '2018-07'").collect()))
    change = store.monthly(2018, 6).where("line_id = 101").selectExpr(
        *[c if c != "skipped_segments" else "CAST(77 AS bigint) AS skipped_segments" for c in report.columns]
    )
    store.upsert(change)
    owners = store.owners()
    assert [m for m in months if owners[m] == max(owners.values())] == ["2018-06"]
    assert store.point(101, 2018, 6).first()["skipped_segments"] == 77 and store.read().count() == report.count()
    assert store.read(version=first).where("skipped_segments = 77 AND line_id = 101 AND year_month = '2018-06'").count() == 0
    assert store.read("2018-06", "2018-06", first).count() == store.monthly(2018, 6).count()
    store.restore(first)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, report.collect()))
    assert store.versions() == [0, 1, 2]
    with pytest.raises(ValueError):
        store.owners(9)
