from __future__ import annotations

import gzip
import io
import json
import random
import zipfile

import pytest
from conftest import SIX_ROWS, datagram
from pyspark.sql import functions as F

from fleetspeed.operators import quality, reports, speed
from fleetspeed.operators.segments import trip_segments
from fleetspeed.plans import route_month
from fleetspeed.sinks import lake as lake_sink
from fleetspeed.sinks import results as result_sink
from fleetspeed.sinks.loads import read_loads
from fleetspeed.sources import archives, lake, results, routes as route_source, zones
from fleetspeed.sources.datagrams import FILE_ROOM, parse_lines, readable, scan_datagrams, scan_lines, to_line

LINE = "0,14-MAY-19,604118,70,34512345,-765310987,391,{line},159,7300125588,2019-05-27 20:14:43,{bus}"


def lines_of(n, bus=lambda i: 1 + i % 7):
    return [LINE.format(line=207, bus=bus(i)) + "\n" for i in range(n)]


def test_scan_keeps_line_order_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    values = [f"line {i:06d}" for i in range(30_000)]
    (folder / "a.csv").write_text("\n".join(values[:25_000]) + "\n")
    (folder / "b.csv").write_text("\n".join(values[25_000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        scanned = scan_lines(spark, str(folder))
        assert scanned.rdd.getNumPartitions() > 3
        rows = scanned.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows] == values
    assert len({r["seq"] for r in rows}) == len(values)


def test_scan_datagrams_drops_unreadable_lines(spark, tmp_path):
    (tmp_path / "d.csv").write_text("".join(lines_of(3)) + "\nnot,enough,fields\n")
    assert scan_lines(spark, str(tmp_path / "d.csv")).count() == 5
    assert scan_datagrams(spark, str(tmp_path / "d.csv")).count() == 3


def test_line_round_trip(frame):
    df = frame(SIX_ROWS)
    back = readable(parse_lines(df.select("seq", to_line().alias("value"))))
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())


def test_routes(spark, tmp_path):
    path = tmp_path / "routes.csv"
    path.write_text(
        ' lineid ,PLANVERSIONID,ShortName,DESCRIPTION,lineId\n207,1,"E7","Old, name",7\n'
        '207,1,E7,"Loop ""East"", main",7\n219,1, N19 ,North hill,7\nx,1,T,bad id,7\n233,1\n'
    )
    rows = {r["line_id"]: (r["short_name"], r["description"]) for r in route_source.read_routes(spark, str(path)).collect()}
    assert rows == {207: ("E7", 'Loop "East", main'), 219: ("N19", "North hill")}


def test_routes_empty_and_without_header(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert route_source.read_routes(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "h.csv").write_text("LINEID,NAME\n1,x\n")
    with pytest.raises(ValueError, match="SHORTNAME"):
        route_source.read_routes(spark, str(tmp_path / "h.csv"))


def test_zone_maps(spark, tmp_path):
    path = tmp_path / "zones.json"
    path.write_text(json.dumps({"lineToZone": {"207": 1, "219": 2, "233": -4}, "userToZone": {"ctrl-001": 1}}, indent=2))
    lines, users = zones.read_zone_maps(spark, str(path))
    assert {tuple(r) for r in lines.collect()} == {(207, 1), (219, 2)}
    assert {tuple(r) for r in users.collect()} == {("ctrl-001", 1)}
    missing = zones.read_zone_maps(spark, str(tmp_path / "none.json"))
    assert [m.count() for m in missing] == [0, 0]


def test_archives(spark, tmp_path):
    for name, first in (("b.zip", 1), ("a.ZIP", 0)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("readme.txt", "no")
            z.writestr("data.csv", "".join(lines_of(25_000, lambda i, f=first: 1 + f)))
            z.writestr("more.csv", "ignored\n")
    target = str(tmp_path / "landed")
    archives.land_archives(spark, target, str(tmp_path))
    stamped = archives.stamp_landed(spark.read.parquet(target))
    rows = readable(parse_lines(stamped))
    assert rows.count() == 50_000 and rows.select("seq").distinct().count() == 50_000
    first = rows.orderBy("seq").first()
    assert first["bus_id"] == 1  # a.ZIP comes first


class _OneWay(io.RawIOBase):
    """A file that cannot go back, so that sizes and checksums stand behind the entries."""

    def __init__(self, path):
        self._file = open(path, "wb")

    def writable(self):
        return True

    def write(self, data):
        return self._file.write(data)

    def close(self):
        self._file.close()
        super().close()


@pytest.mark.parametrize("packing", [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_archives_are_read_in_ranges(spark, tmp_path, packing, ending):
    rng = random.Random(7)
    texts = [f"{i},{rng.random()},ñ\x85{'x' * rng.randrange(300)}" for i in range(8_000)] + ["", "last"]
    with zipfile.ZipFile(tmp_path / "seen.zip", "w", packing) as z:
        z.writestr("notes.txt", rng.randbytes(30_000))
        z.writestr("data.csv", ending.join(texts))
    if packing == zipfile.ZIP_DEFLATED:
        with zipfile.ZipFile(_OneWay(tmp_path / "streamed.zip"), "w", packing) as z:
            z.writestr("notes.txt", "PK " * 9_000)
            with z.open("DATA.CSV", "w", force_zip64=True) as entry:
                entry.write((ending.join(texts) + ending).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = archives.archive_lines(spark, str(tmp_path)).orderBy("path", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {}
    for row in lines:
        assert row["line_no"] == len(found.setdefault(row["path"], []))
        found[row["path"]].append(row["value"])
    assert len(found) == (2 if packing == zipfile.ZIP_DEFLATED else 1)
    assert all(got == texts for got in found.values())


@pytest.mark.parametrize("damage", ["cut", "changed", "other"])
def test_damaged_archives_are_errors(spark, tmp_path, damage):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("data.csv", "one\ntwo\n" * 500)
    whole = (tmp_path / "x.zip").read_bytes()
    changed = {"cut": whole[:2000], "changed": whole.replace(b"two", b"tow", 1), "other": b"no archive"}
    (tmp_path / "x.zip").write_bytes(changed[damage])
    with pytest.raises(Exception, match="too early|damaged|not a zip"):
        archives.archive_lines(spark, str(tmp_path)).count()


def test_archive_without_csv_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("readme.txt", "no")
    with pytest.raises(Exception, match="no .csv entry"):
        archives.archive_lines(spark, str(tmp_path)).count()


MONTH_ROWS = SIX_ROWS[:4] + [
    datagram(20, 207, 5, "2019-05-31 23:59:30", 30000000, -760000000, 12),
    datagram(21, 207, 5, "2019-06-01 00:00:30", 30001000, -760000000, 12),
    datagram(22, -1, 5, "2019-06-01 00:00:30", 30001000, -760000000, 13),
]


@pytest.fixture()
def small_lake(spark, frame, tmp_path):
    folder = str(tmp_path / "lake")
    lake_sink.write_lake(frame(MONTH_ROWS), folder)
    return folder


def test_lake_round_trip(spark, frame, small_lake):
    keys = {tuple(r) for r in lake.lake_partitions(spark, small_lake).collect()}
    assert keys == {(207, 2019, "05"), (207, 2019, "06"), (-1, 2019, "06")}
    part = lake.lake_partition(spark, small_lake, 207, 2019, 5)
    assert sorted(r["seq"] for r in part.collect()) == [1, 2, 3, 4, 20]
    assert lake.lake_partition(spark, small_lake, 5, 2019, 5).count() == 0
    names = frame(MONTH_ROWS).columns
    assert sorted(lake.read_lake(spark, small_lake).select(*names).collect()) == sorted(frame(MONTH_ROWS).collect())
    lake_sink.write_lake(frame(MONTH_ROWS[:1]), small_lake, "bulk-1")  # another load appends
    assert lake.read_lake(spark, small_lake).count() == 8


def test_absent_lake_is_empty(spark, tmp_path):
    assert lake.read_lake(spark, str(tmp_path / "none")).count() == 0
    assert lake.lake_partitions(spark, str(tmp_path / "none")).count() == 0


def test_lake_reads_are_pruned(spark, small_lake):
    for df in (
        lake.lake_partition(spark, small_lake, 207, 2019, 5),
        lake.lake_months(spark, small_lake, "2019-05", "2019-05"),
    ):
        assert all("line_id=-1" not in f and "month=06" not in f for f in _files_read(df))


def _files_read(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_month_of_the_lake_keeps_the_crossing_segment(spark, routes, small_lake):
    for context in (None, 1):
        june = route_month.run_month(spark, small_lake, routes, 2019, 6, context_months=context)
        assert {r["line_id"]: r["valid_segments"] for r in june.collect()} == {207: 1, 219: 0, 233: 0}
    arrival = route_month.run_month(spark, small_lake, routes, 2019, 6, mode="arrival")
    assert {r["line_id"]: r["valid_segments"] for r in arrival.collect()}[207] == 0
    ranged = route_month.run_range(spark, small_lake, routes, (2019, 4), (2019, 6), context_months=1)
    assert ranged.count() == 9


def test_build_lake(spark, routes, tmp_path):
    (tmp_path / "d.csv").write_text("".join(lines_of(5)) + LINE.format(line=9, bus=1) + "\nbad\n")
    counters = route_month.build_lake(spark, routes, str(tmp_path / "lake"), str(tmp_path / "d.csv"))
    assert counters == {"processed": 7, "accepted": 5, "rejected": 2}
    assert lake.read_lake(spark, str(tmp_path / "lake")).count() == 5


def trip_lines(first, n):
    """Reports of one trip a minute apart, moving east."""
    line = "0,14-MAY-19,604118,70,34512345,{lon},391,207,31,7300125588,2019-05-14 06:{minute:02d}:00,42"
    return "".join(line.format(lon=-765310987 + 9000 * k, minute=k) + "\n" for k in range(first, first + n))


def test_loads_continue_each_other(spark, routes, tmp_path):
    for name, first in (("a", 0), ("b", 10)):
        (tmp_path / f"{name}.csv").write_text(trip_lines(first, 10))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    route_month.build_lake(spark, routes, one, f"{tmp_path}/*.csv")
    for name in ("a", "b"):
        route_month.build_lake(spark, routes, two, f"{tmp_path}/{name}.csv")
    # The second load is repeated and replaces itself.
    route_month.build_lake(spark, routes, two, f"{tmp_path}/b.csv", load="bulk-1")
    for folder in (one, two):
        report = route_month.run_month(spark, folder, routes, 2019, 5).where("line_id = 207").first()
        assert (report["valid_segments"], report["skipped_segments"]) == (19, 0)
    compact = str(tmp_path / "compact")
    lake_sink.compact_lake(spark, two, compact)
    assert sorted(lake.read_lake(spark, compact).collect()) == sorted(lake.read_lake(spark, two).collect())
    loads = {r["load"]: (r["first"], r["size"]) for r in read_loads(spark, compact).collect()}
    sizes = [(tmp_path / f"{n}.csv").stat().st_size + FILE_ROOM for n in "ab"]
    assert loads == {"bulk-0": (0, sizes[0]), "bulk-1": (sizes[0], sizes[1])}
    with pytest.raises(ValueError, match="numbers of input"):
        route_month.build_lake(spark, routes, two, f"{tmp_path}/*.csv", load="bulk-1")


def test_compressed_lines_are_refused(spark, tmp_path):
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(b"line\n"))
    with pytest.raises(ValueError, match="unpack compressed"):
        scan_lines(spark, str(tmp_path))


def test_csv_lake(spark, tmp_path):
    folder = tmp_path / "csv" / "lineId=207" / "year=2019" / "month=05"
    folder.mkdir(parents=True)
    (folder / "part-0.csv").write_text("".join(lines_of(4)) + "bad\n")
    (folder / "part-1.csv").write_text("".join(lines_of(2)))
    assert lake.csv_lake(spark, str(tmp_path / "csv")).count() == 6


def test_shards(spark, tmp_path):
    lines = spark.createDataFrame(
        [(v.strip(),) for v in lines_of(40, lambda i: i)] + [("bad",), (LINE.format(line=1, bus="x"),)], "value string"
    )
    target = str(tmp_path / "shards")
    lake_sink.write_shards(lines, target, 20)
    found = {r["shard"]: r["n"] for r in spark.read.text(target).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert found == {f"chunk-{i:02d}": 1 if i == 0 else 2 for i in range(20)}  # bus 0 is dropped
    kept = lake_sink.with_shard(lines, 20, drop_unreadable=False)
    assert kept.count() == 42 and kept.where("shard is null").count() == 0
    with pytest.raises(ValueError):
        lake_sink.with_shard(lines, 0)


REPORT = [
    (207, "E7", "Harbour - Hill station", "2019-05", 8421.70314, 530.204166667, 15.883887, 90417, 3120, "OK"),
    (-1, "TESTGT1", "NA", "2019-05", 0.004651, 0.060555556, 0.0768, 1, 11, "OK"),
    (8, 'say "x", y', "Andrés", "2019-05", 0.0, 0.0, 0.0, 0, 0, "NO_DATA"),
    (207, "E7", "Harbour", "2019-04", 1.0, 0.5, 2.0, 3, 4, "OK"),
]


@pytest.fixture(scope="module")
def report(spark):
    from fleetspeed.schema import SPEED_SCHEMA

    return spark.createDataFrame(REPORT, SPEED_SCHEMA)


def read_text(spark, path):
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    text = ""
    for f in files:
        with open(f.removeprefix("file:"), encoding="utf-8") as handle:
            text += handle.read()
    return text


def test_speed_csv_bytes(spark, report, tmp_path):
    result_sink.write_speed_csv(report, str(tmp_path / "out"))
    lines = read_text(spark, str(tmp_path / "out")).splitlines()
    assert lines[0].startswith("lineId,shortName,description,yearMonth,")
    assert [x.split(",")[0] for x in lines[1:]] == ["207", "-1", "8", "207"]
    assert lines[4] == '207,"E7","Harbour - Hill station",2019-05,8421.703140,530.204166667,15.883887,90417,3120,OK'
    assert lines[3] == '8,"say ""x"", y","Andrés",2019-05,0.000000,0.000000000,0.000000,0,0,NO_DATA'


def test_speed_csv_round_trip(spark, report, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    result_sink.write_store(report, first)
    back = results.read_speed_results(spark, first)
    assert sorted(back.collect()) == sorted(report.collect())
    result_sink.write_store(back, second)
    assert read_text(spark, first) == read_text(spark, second)
    assert [x.split(",")[0] for x in read_text(spark, first).splitlines()[1:]] == ["-1", "8", "207", "207"]


@pytest.mark.parametrize("line", ["1,2,3", '1,"a","b",2019-05,x,0,0,1,1,OK'])
def test_bad_result_row_raises(spark, tmp_path, line):
    (tmp_path / "r.csv").write_text("\n" + line + "\n")
    with pytest.raises(Exception):  # noqa: B017
        results.read_speed_results(spark, str(tmp_path / "r.csv")).collect()


def test_report_json(spark, report):
    texts = [r["j"] for r in report.select(result_sink.report_json().alias("j")).collect()]
    first = json.loads(texts[0])
    assert list(first) == [
        "lineId", "shortName", "description", "yearMonth", "averageSpeedKmH", "totalDistanceKm",
        "totalTimeHours", "validSegments", "skippedSegments", "status",
    ]
    assert json.loads(texts[2])["shortName"] == 'say "x", y'
    array = json.loads(result_sink.reports_json_array(report).first()["json"])
    assert [(r["yearMonth"], r["lineId"]) for r in array] == [
        ("2019-04", 207), ("2019-05", -1), ("2019-05", 8), ("2019-05", 207),
    ]


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_json_array_in_bounded_chunks(spark, report, tmp_path, rows):
    whole = json.loads(result_sink.reports_json_array(report).first()["json"])
    chunks = result_sink.reports_json_chunks(report, rows).where("part = 1").collect()
    assert len(chunks) == -(-4 // rows) and all(len(json.loads(f"[{c['json'].lstrip(',')}]")) <= rows for c in chunks)
    result_sink.write_json_array(report, str(tmp_path / "a.json"), rows)
    texts = "".join(f.read_text() for f in sorted((tmp_path / "a.json").glob("part-*")))
    assert json.loads(texts) == whole
    result_sink.write_json_array(report.limit(0), str(tmp_path / "none.json"), rows)
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none.json").glob("part-*")))) == []


def test_report_queries(report):
    assert reports.point(report, 207, 2019, 5).first()["valid_segments"] == 90417
    assert reports.point(report, 207, 2018, 5).count() == 0
    assert reports.monthly(report, 2019, 5).count() == 3
    assert reports.in_range(report, (2019, 4), (2019, 5)).count() == 4
    assert reports.in_range(report, (2018, 1), (2019, 4)).count() == 1
    assert {r["status"]: r["reports"] for r in reports.run_summary(report).collect()} == {"OK": 3, "NO_DATA": 1}
    assert [r["line_id"] for r in reports.of_routes(report, [207, 8]).collect()] == [207, 207, 8]
    (delta,) = reports.month_deltas(report).collect()
    assert delta["delta_kmh"] == pytest.approx(13.883887)
    bands = {r["line_id"]: r["band"] for r in reports.comparison(report, (2019, 5), (2019, 5)).collect()}
    assert bands == {207: "good", -1: "bad", 8: "bad"}
    assert [r["line_id"] for r in reports.store_order(report).collect()] == [-1, 8, 207, 207]
    assert reports.preview(report, 2).count() == 2


def test_upsert_last_write_wins(report):
    change = report.where("line_id = 207 and year_month = '2019-05'").withColumn("valid_segments", F.lit(1).cast("long"))
    store = reports.upserted(report, change)
    assert store.count() == 4
    assert reports.point(store, 207, 2019, 5).first()["valid_segments"] == 1


def test_save_months_replaces_only_given_months(spark, report, tmp_path):
    path = str(tmp_path / "store")
    reports.save_months(report, path)
    reports.save_months(report.where("year_month = '2019-04'").withColumn("skipped_segments", F.lit(9).cast("long")), path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert back.where("skipped_segments = 9").count() == 1


def test_reconcile(report):
    assert reports.reconcile(report, report).count() == 0
    near = report.withColumn("average_speed_kmh", F.col("average_speed_kmh") + 0.00009)
    assert reports.reconcile(near, report).count() == 0
    far = report.withColumn("average_speed_kmh", F.col("average_speed_kmh") + 0.00011)
    assert {r["difference"] for r in reports.reconcile(far, report).collect()} == {"SPEED"}
    short = report.where("line_id <> 8")
    assert [r["difference"] for r in reports.reconcile(short, report).collect()] == ["MISSING"]
    assert [r["difference"] for r in reports.reconcile(report, short).collect()] == ["UNEXPECTED"]


def test_named_report_has_placeholders(frame, routes):
    df = frame([datagram(1, 999, 1, "2019-05-27 10:00:00", 0, 5, 1)])
    (row,) = speed.named_report(speed.route_month_totals(trip_segments(df)), routes).collect()
    assert (row["short_name"], row["description"], row["status"]) == ("UNKNOWN", "NA", "NO_DATA")


def test_quality_of_the_lake_rows(spark, routes, small_lake):
    assert quality.valid_datagrams(lake.read_lake(spark, small_lake), routes).count() == 6
