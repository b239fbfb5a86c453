from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import pytest
from conftest import SIX_ROWS, SMALL, datagram
from pyspark.sql import functions as F

from fleetcheck import inputs
from fleetspeed import Limits
from fleetspeed.operators import quality, speed
from fleetspeed.operators.metrics import run_metrics
from fleetspeed.operators.segments import trip_segments
from fleetspeed.plans.route_month import speed_report

FAR = (34516000, -765320000), (34512345, -765310987)


def totals_of(df, limits=Limits(), mode="normative"):
    rows = speed.route_month_totals(trip_segments(df, limits, mode)).collect()
    return {
        (r["line_id"], r["year_month"]): (
            r["valid_segments"],
            r["skipped_segments"],
            pytest.approx(r["total_distance_km"], rel=1e-9, abs=1e-12),
            pytest.approx(r["total_time_hours"], rel=1e-9, abs=1e-12),
        )
        for r in rows
    }


def km_between(a, b):
    lat1, lon1, lat2, lon2 = (radians(x / 1e7) for x in (*a, *b))
    h = sin((lat2 - lat1) / 2) ** 2 + cos(lat1) * cos(lat2) * sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(h))


def sequential(rows):
    """Row-by-row reading of the normative rules: the independent check."""
    last, sums = {}, defaultdict(lambda: [0, 0, 0.0, 0.0])
    for r in sorted(rows, key=lambda r: r["seq"]):
        trip = (r["bus_id"], r["line_id"], r["trip_id"])
        cell = sums[(r["line_id"], r["ts"].strftime("%Y-%m"))]
        before = last.get(trip)
        if before and r["ts"] <= before["ts"]:
            cell[1] += 1
            continue
        last[trip] = r
        if not before:
            continue
        hours = (r["ts"] - before["ts"]).total_seconds() / 3600
        km = km_between((before["raw_lat"], before["raw_lon"]), (r["raw_lat"], r["raw_lon"]))
        if hours > 300 / 3600 or km / hours > 120:
            cell[1] += 1
        else:
            cell[0] += 1
            cell[2] += km
            cell[3] += hours
    return {k: tuple(v) for k, v in sums.items()}


def test_six_rows(frame, routes):
    df = frame(SIX_ROWS)
    report = {r["line_id"]: r for r in speed_report(df, routes).collect()}
    assert set(report) == {207, 219, 233}
    assert (report[207]["status"], report[207]["valid_segments"], report[207]["skipped_segments"]) == ("OK", 2, 1)
    assert report[219]["status"] == report[233]["status"] == "NO_DATA"
    tagged = quality.with_reject_reason(df, routes)
    counters = run_metrics(tagged, trip_segments(quality.valid_datagrams(df, routes))).first()
    assert tuple(counters) == (6, 4, 2)


def test_exactly_five_minutes_is_kept(frame):
    rows = lambda s: frame(
        [
            datagram(1, 207, 1, "2019-05-27 10:00:00", *FAR[0], 10),
            datagram(2, 207, 1, datetime(2019, 5, 27, 10, 5) + timedelta(microseconds=s), *FAR[1], 10),
        ]
    )
    assert totals_of(rows(0))[(207, "2019-05")][:2] == (1, 0)
    assert totals_of(rows(500))[(207, "2019-05")][:2] == (0, 1)
    assert totals_of(rows(1_000_000))[(207, "2019-05")][:2] == (0, 1)


def test_speed_limit_is_inclusive(frame):
    df = frame(
        [
            datagram(1, 207, 1, "2019-05-27 10:00:00", 0, 0, 10),
            datagram(2, 207, 1, "2019-05-27 10:01:00", 0, 1_000_000, 10),
        ]
    )
    km = trip_segments(df).where("segment_ok is not null").first()["km"]
    assert totals_of(df, Limits(max_speed_kmh=km / (1 / 60)))[(207, "2019-05")][0] == 1
    assert totals_of(df, Limits(max_speed_kmh=km / (1 / 60) - 1e-6))[(207, "2019-05")][:2] == (0, 1)


def test_trips_are_not_joined(frame):
    df = frame(
        [
            datagram(1, 207, 1, "2019-05-27 10:00:00", *FAR[0], 10),
            datagram(2, 207, 2, "2019-05-27 10:01:00", *FAR[1], 10),
        ]
    )
    for mode in ("normative", "sorted", "arrival"):
        assert totals_of(df, mode=mode)[(207, "2019-05")][:2] == (0, 0)


def test_late_row_does_not_advance_but_rejected_segment_does(frame):
    lat = 30000000
    df = frame(
        [
            datagram(1, 207, 1, "2019-05-27 10:00:00", lat, 0, 10),
            datagram(2, 207, 1, "2019-05-27 09:59:00", lat + 9000, 0, 10),  # late
            datagram(3, 207, 1, "2019-05-27 10:00:00", lat + 9000, 0, 10),  # equal time: late
            datagram(4, 207, 1, "2019-05-27 10:01:00", lat + 1000, 0, 10),  # pairs with 1
            datagram(5, 207, 1, "2019-05-27 10:20:00", lat + 2000, 0, 10),  # gap
            datagram(6, 207, 1, "2019-05-27 10:21:00", lat + 3000, 0, 10),  # pairs with 5
        ]
    )
    rows = {r["seq"]: r for r in trip_segments(df).collect()}
    assert [rows[i]["late"] for i in range(1, 7)] == [False, True, True, False, False, False]
    assert [rows[i]["segment_ok"] for i in range(1, 7)] == [None, None, None, True, False, True]
    assert rows[4]["km"] == pytest.approx(km_between((lat, 0), (lat + 1000, 0)))
    # The same rows in the other modes: late rows take part.
    assert totals_of(df, mode="sorted")[(207, "2019-05")][:2] == (3, 2)
    assert totals_of(df, mode="arrival")[(207, "2019-05")][:2] == (3, 2)


def test_segment_over_the_month_end(frame):
    df = frame(
        [
            datagram(1, 207, 1, "2019-05-31 23:59:30", 30000000, 0, 10),
            datagram(2, 207, 1, "2019-06-01 00:00:30", 30001000, 0, 10),
        ]
    )
    assert totals_of(df)[(207, "2019-06")][:2] == (1, 0)
    assert totals_of(df)[(207, "2019-05")][:2] == (0, 0)
    assert totals_of(df, mode="arrival")[(207, "2019-06")][:2] == (0, 0)


def test_line_minus_one_counts_only_in_the_normative_mode(frame):
    df = frame(
        [
            datagram(1, -1, 1, "2019-05-27 10:00:00", 30000000, 0, 10),
            datagram(2, -1, 1, "2019-05-27 10:01:00", 30001000, 0, 10),
        ]
    )
    assert totals_of(df)[(-1, "2019-05")][0] == 1
    assert totals_of(df, mode="sorted") == totals_of(df, mode="arrival") == {}


def test_unknown_mode(frame):
    with pytest.raises(ValueError):
        trip_segments(frame(SIX_ROWS), mode="v9")


@pytest.fixture(scope="module")
def derived(spark):
    catalogue = inputs.routes(spark, SMALL)
    return quality.valid_datagrams(inputs.datagrams(spark, SMALL), catalogue).cache()


def test_derived_rows_against_sequential_reading(derived):
    assert totals_of(derived) == sequential(derived.collect())


@pytest.mark.parametrize("mode", ["normative", "sorted", "arrival"])
def test_slices_do_not_change_the_result(derived, mode):
    whole = totals_of(derived, Limits(slice_rows=None), mode)
    for slice_rows in (2, 50):
        assert totals_of(derived, Limits(slice_rows=slice_rows), mode) == whole


def test_one_key_with_a_third_of_the_rows(frame):
    rng = random.Random(7)
    rows = []
    for seq in range(900):
        hot = seq % 3 == 0
        ts = datetime(2019, 5, 30, 12) + timedelta(seconds=seq * 20 + rng.choice([0, 0, 0, -90, -4000, 300]))
        trip = 1 if hot else seq % 11
        bus = 1 if hot else 2 + seq % 5
        rows.append(datagram(seq, 207, trip, ts, 30000000 + rng.randrange(4000), rng.randrange(4000), bus))
    df = frame(rows)
    expected = sequential(df.collect())
    assert totals_of(df, Limits(slice_rows=25)) == expected
    assert totals_of(df.repartition(7), Limits(slice_rows=25)) == expected
    assert totals_of(df.orderBy(F.rand(3)), Limits(slice_rows=None)) == expected


def test_merge_of_bus_shards(derived, spark):
    catalogue = inputs.routes(spark, SMALL)
    parts = [
        speed.route_month_totals(trip_segments(derived.where(F.pmod("bus_id", F.lit(3)) == i))) for i in range(3)
    ]
    merged = speed.complete_report(speed.merged_totals(*parts), catalogue).collect()
    whole = speed.complete_report(speed.route_month_totals(trip_segments(derived)), catalogue).collect()
    assert [(r["line_id"], r["year_month"], r["valid_segments"], r["skipped_segments"]) for r in merged] == [
        (r["line_id"], r["year_month"], r["valid_segments"], r["skipped_segments"]) for r in whole
    ]
    for a, b in zip(merged, whole):
        assert a["average_speed_kmh"] == pytest.approx(b["average_speed_kmh"], rel=1e-9)


def test_report_grid_and_order(frame, routes):
    df = frame(
        SIX_ROWS + [datagram(9, 219, 2, "2019-06-01 10:00:00", 30000000, -760000000, 11)]
    )
    rows = speed_report(df, routes).collect()
    assert [(r["year_month"], r["line_id"]) for r in rows] == [
        (m, line) for m in ("2019-05", "2019-06") for line in (207, 219, 233)
    ]
    empty = speed_report(df.limit(0), routes)
    assert empty.count() == 0


def test_range_report_has_every_month(frame, routes):
    totals = speed.route_month_totals(trip_segments(quality.valid_datagrams(frame(SIX_ROWS), routes)))
    rows = speed.range_report(totals, routes, "2018-05", "2019-05").collect()
    assert len(rows) == 13 * 3
    assert sum(r["status"] == "OK" for r in rows) == 1
    single = speed.month_report(totals, routes, "2019-05").collect()
    assert [r["line_id"] for r in single] == [207, 219, 233]
