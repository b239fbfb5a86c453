from __future__ import annotations

import pytest
from conftest import SIX_ROWS, datagram
from pyspark.sql import functions as F

from fleetspeed.operators import metrics, quality
from fleetspeed.sinks.results import metrics_csv
from fleetspeed.sources.datagrams import parse_lines

AT = "2019-05-27 10:00:00"
GOOD = (1, 207, 7, AT, 34512345, -765310987, 10)
CASES = [
    (GOOD, None),
    ((2, 207, 7, AT, -1, -1, 0), "LAT_MINUS_ONE"),
    ((3, 207, 7, AT, 34512345, -1, 0), "LON_MINUS_ONE"),
    ((4, 207, -1, AT, 34512345, -765310987, 0), "BUSID_NONPOSITIVE"),
    ((5, 207, 7, AT, 34512345, -765310987, -3), "BUSID_NONPOSITIVE"),
    ((6, 99999, -1, AT, 34512345, -765310987, 10), "TRIPID_NEGATIVE"),
    ((7, 99999, 7, AT, 34512345, -765310987, 10), "LINEID_NOT_ACTIVE"),
    ((8, 207, 7, None, 34512345, -765310987, 10), "NULL_DATE"),
]


@pytest.fixture(scope="module")
def rows(frame):
    return frame([datagram(*case) for case, _ in CASES])


def test_first_broken_rule_is_the_reason(rows, routes):
    found = {r["seq"]: r["reject_reason"] for r in quality.with_reject_reason(rows, routes).collect()}
    assert found == {case[0]: reason for case, reason in CASES}


def test_split_agrees_with_validity(rows, routes):
    tagged = quality.with_reject_reason(rows, routes)
    valid = {r["seq"] for r in quality.valid_datagrams(rows, routes).collect()}
    assert {r["seq"] for r in quality.accepted(tagged).collect()} == valid == {1}
    assert quality.rejected(tagged).count() == 7
    assert {r["seq"] for r in quality.off_active_route(rows, routes).collect()} == {6, 7}


def test_counts_and_sample(rows, routes):
    tagged = quality.with_reject_reason(rows, routes)
    counts = {r["reason"]: r["rejects"] for r in quality.rejects_by_reason(tagged).collect()}
    assert counts["BUSID_NONPOSITIVE"] == 2 and sum(counts.values()) == 7
    assert [r["seq"] for r in quality.reject_sample(tagged, 3).collect()] == [2, 3, 4]
    split = {r["line_id"]: (r["accepted"], r["rejected"]) for r in quality.accept_reject_counts(tagged).collect()}
    assert split == {207: (1, 5), 99999: (0, 2)}


def test_unreadable_lines_are_malformed(spark, routes):
    lines = spark.createDataFrame([(1, "not,enough,fields")], "seq bigint, value string")
    tagged = quality.with_reject_reason(parse_lines(lines), routes)
    assert tagged.first()["reject_reason"] == "MALFORMED:FieldCount"


def test_repeated_route_does_not_repeat_rows(rows, routes):
    assert quality.valid_datagrams(rows, routes.union(routes)).count() == 1
    assert quality.with_reject_reason(rows, routes.union(routes)).count() == len(CASES)


def test_guard_and_cap(spark, frame):
    df = spark.createDataFrame([("", 1), ("x", 0), ("x", 1), (None, 1)], "d string, b int")
    assert [r[0] for r in df.select(quality.has_content(F.col("d"), F.col("b"))).collect()] == [
        False, False, True, False,
    ]
    capped = quality.first_rows(frame(SIX_ROWS).orderBy(F.desc("seq")), 2)
    assert [r["seq"] for r in capped.collect()] == [1, 2]


def test_observed_counters_while_writing(rows, routes, tmp_path):
    counted, watch = metrics.observed(quality.with_reject_reason(rows, routes), "t")
    counted.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"processed": 8, "accepted": 1, "rejected": 7}


def test_metrics_csv(spark):
    counters = spark.createDataFrame(
        [(8145462, 6744428, 1401034)], "processed_rows bigint, valid_rows bigint, skipped_rows bigint"
    )
    row = metrics.run_metrics_row(counters, "monolith", "datagrams.csv", 14551, 111, 77.09)
    head, line = [r["value"] for r in metrics_csv(row).collect()]
    assert head.startswith("version,dataset,processedRows")
    assert line == '"monolith","datagrams.csv",8145462,6744428,1401034,14551,559787.09,77.09,111'
    row = metrics.run_metrics_row(counters, "v", "d", 14551, 111, 77.09, worker_count=4)
    head, line = [r["value"] for r in metrics_csv(row).collect()]
    assert head.endswith("resultRows,workerCount") and line.endswith(",111,4")
