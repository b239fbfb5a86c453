from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL, datagram
from pyspark.sql import functions as F

from fleetcheck import inputs, queries
from fleetspeed.operators import monitoring, quality
from fleetspeed.operators.segments import trip_segments
from fleetspeed.schema import DATAGRAM_SCHEMA, Limits
from fleetspeed.sinks import lake as lake_sink
from fleetspeed.sinks.lake import write_lake
from fleetspeed.sources import landing
from fleetspeed.sources.datagrams import FILE_ROOM, to_line
from fleetspeed.sources.lake import read_lake
from fleetspeed.streaming import carried, delivery, ingest, vehicles
from test_monitoring import STATES, at, reports_of_buses, subscriptions, zones  # noqa: F401

PIECES = 4


@pytest.fixture(scope="module")
def derived(spark):
    return inputs.datagrams(spark, SMALL).cache()


def land(df, folder, piece, pieces):
    """Put one consecutive part of the rows, in mixed order, into the landing folder."""
    part = df.where((F.col("seq") >= piece * 1000 // pieces) & (F.col("seq") < (piece + 1) * 1000 // pieces))
    part.orderBy(F.hash("seq")).coalesce(1).write.mode("append").parquet(folder)


def drain(stream, folder):
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def result(spark, stream, folder):
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def source(spark, folder):
    return landing.stream_datagrams(spark, folder, files_per_trigger=1)


def same(actual, expected):
    columns = expected.columns
    assert sorted(map(str, actual.select(*columns).collect())) == sorted(map(str, expected.collect()))


@pytest.fixture()
def landed(spark, derived, tmp_path):
    folder = str(tmp_path / "landing")
    for piece in range(PIECES):
        land(derived, folder, piece, PIECES)
    return folder


def test_updates_equal_the_batch_form_over_restarts(spark, derived, tmp_path):
    folder, line_zones = str(tmp_path), inputs.line_zones(spark, SMALL)
    for piece in range(PIECES):
        land(derived, f"{folder}/landing", piece, PIECES)
        if piece % 2:  # a new query goes on from the checkpoint of the last one
            stream = vehicles.bus_update_stream(source(spark, f"{folder}/landing"), line_zones)
            drain(stream, folder)
    same(result(spark, stream, folder), monitoring.bus_updates(derived, line_zones))


def test_publish_writes_updates_and_alerts(spark, derived, landed, tmp_path):
    line_zones = inputs.line_zones(spark, SMALL)
    paths = [str(tmp_path / n) for n in ("updates", "alerts", "checkpoint")]
    vehicles.publish(source(spark, landed), line_zones, *paths).awaitTermination()
    same(spark.read.parquet(paths[0]), monitoring.bus_updates(derived, line_zones))
    zoned = monitoring.with_line_zone(monitoring.consumable(derived), line_zones)
    same(spark.read.parquet(paths[1]), monitoring.critical_alerts(zoned))


def test_alert_stream(spark, derived, landed, tmp_path):
    line_zones = inputs.line_zones(spark, SMALL)
    stream = vehicles.critical_alert_stream(source(spark, landed), line_zones)
    drain(stream, str(tmp_path))
    zoned = monitoring.with_line_zone(monitoring.consumable(derived), line_zones)
    same(result(spark, stream, str(tmp_path)), monitoring.critical_alerts(zoned))


def test_segments_equal_the_batch_form(spark, derived, landed, tmp_path):
    catalogue = inputs.routes(spark, SMALL)
    stream = vehicles.trip_segment_stream(source(spark, landed), catalogue)
    drain(stream, str(tmp_path))
    expected = trip_segments(quality.valid_datagrams(derived, catalogue))
    shown = ["seq", "late", "gap_us", "month_no", "segment_ok"]
    same(result(spark, stream, str(tmp_path)), expected.select(*shown))


def test_processors_hold_rows_once_and_pass_them_on_in_batches():
    """A bus that owns a whole micro-batch: what its state takes beside its rows stays below their size."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from fleetspeed.streaming.processors import OperationalState

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    n, batch = 400_000, 10_000
    mixed = np.random.default_rng(1).permutation(n)
    wide = {f"c{k}": np.arange(n) for k in range(6)}
    whole = pd.DataFrame({"seq": mixed, "event_type": np.where(mixed % 5 == 0, 9, 0), "odometer": mixed // 4, **wide})
    batches = [whole.iloc[at : at + batch].copy() for at in range(0, n, batch)]
    processor = OperationalState()
    processor._odometer = Held()
    tracemalloc.start()
    counts = {}
    for told in processor.handleInputRows((1,), iter(batches), None):
        assert len(told) <= batch
        for label, times in told["operational_state"].value_counts().items():
            counts[label] = counts.get(label, 0) + times
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ordered = [(seq // 4, seq % 5 == 0) for seq in range(n)]
    expected, last = {}, None
    for odometer, exceptional in ordered:
        label = "CRITICO" if exceptional else "PARADO" if odometer == last else "EN_RUTA"
        expected[label] = expected.get(label, 0) + 1
        last = last if exceptional else odometer
    assert counts == expected and processor._odometer.value == ((n - 1) // 4,)
    assert peak < whole.memory_usage(deep=True).sum()


def test_signal_loss_equals_the_gap_list(spark, derived, landed, tmp_path):
    stream = vehicles.signal_loss_stream(monitoring.consumable(source(spark, landed)), live=False)
    drain(stream, str(tmp_path))
    gaps = monitoring.signal_gaps(monitoring.consumable(derived))
    same(result(spark, stream, str(tmp_path)), gaps.select("bus_id", "last_ts"))


def test_late_buses_and_clocks_ahead_lose_nothing(spark, frame, tmp_path):
    """Bus 1 sends after two hours without coverage, the clock of bus 2 runs a day ahead."""
    rows = [
        [datagram(1, 207, 1, at(0), 1, 1, 1), datagram(2, 207, 1, at(86400), 1, 1, 2)],
        [datagram(3, 207, 1, at(86410), 1, 1, 2)],
        [datagram(4, 207, 1, at(30), 1, 1, 1), datagram(5, 207, 1, at(7230), 1, 1, 1)],
        [datagram(6, 207, 1, at(86500), 1, 1, 2)],
    ]
    folder = str(tmp_path)
    for part in rows:
        frame(part).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        stream = vehicles.signal_loss_stream(source(spark, f"{folder}/landing"), live=False)
        drain(stream, folder)  # every batch is a restart
    found = sorted((r["bus_id"], r["last_ts"]) for r in result(spark, stream, folder).collect())
    assert found == [(1, at(30)), (2, at(86410))]


def test_ingest_of_lines(spark, derived, landed, tmp_path):
    folder, catalogue = str(tmp_path), inputs.routes(spark, SMALL)
    lines = derived.orderBy("seq").select(to_line().alias("value"))
    lines.coalesce(1).write.mode("append").text(f"{folder}/lines")
    spark.createDataFrame([("bad",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/lines")
    for _ in range(2):  # the second run has nothing new to do
        ingest.ingest_lines(
            landing.stream_lines(spark, f"{folder}/lines", files_per_trigger=1),
            catalogue, f"{folder}/lake", f"{folder}/rejects", f"{folder}/checkpoint",
        ).awaitTermination()
    lake = read_lake(spark, f"{folder}/lake")
    valid = quality.valid_datagrams(derived, catalogue)
    assert lake.count() == valid.count()
    assert lake.select("seq").distinct().count() == valid.count()
    stored = trip_segments(lake).agg(F.count_if("segment_ok"), F.count_if("late")).first()
    assert tuple(stored) == tuple(trip_segments(valid).agg(F.count_if("segment_ok"), F.count_if("late")).first())
    tagged = quality.with_reject_reason(derived, catalogue)
    expected = {r["reason"]: r["rejects"] for r in quality.rejects_by_reason(tagged).collect()}
    found = {r["reason"]: r["rejects"] for r in quality.rejects_by_reason(spark.read.parquet(f"{folder}/rejects")).collect()}
    assert found == {**expected, "MALFORMED:FieldCount": 1}


def test_repeated_batch_replaces_itself(spark, derived, tmp_path):
    folder = str(tmp_path)
    tagged = quality.with_reject_reason(derived, inputs.routes(spark, SMALL))
    for _ in range(2):
        ingest.archive_batch(tagged, 3, f"{folder}/lake", f"{folder}/rejects")
    ingest.archive_batch(tagged.limit(0), 4, f"{folder}/lake", f"{folder}/rejects")
    assert read_lake(spark, f"{folder}/lake").count() + spark.read.parquet(f"{folder}/rejects").count() == 1000


@pytest.mark.parametrize("rows_a_file", [300, 500_000])
def test_accepted_rows_are_passed_on_in_order(spark, derived, tmp_path, monkeypatch, rows_a_file):
    monkeypatch.setattr(ingest, "PASSED_ROWS", rows_a_file, raising=False)
    folder, catalogue = str(tmp_path), inputs.routes(spark, SMALL)
    tagged = quality.with_reject_reason(derived, catalogue).repartition(4)
    for _ in range(2):  # a repeated batch replaces itself
        ingest.archive_batch(tagged, 0, f"{folder}/lake", f"{folder}/rejects", f"{folder}/accepted")
    stream = vehicles.bus_update_stream(source(spark, f"{folder}/accepted"), inputs.line_zones(spark, SMALL))
    drain(stream, folder)
    accepted = quality.valid_datagrams(derived, catalogue).select(*derived.columns)
    same(result(spark, stream, folder), monitoring.bus_updates(accepted, inputs.line_zones(spark, SMALL)))


def test_landing_reads_the_table_twice_however_many_files_it_makes(spark, derived, tmp_path, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = derived.mapInArrow(counted, derived.schema)
    monkeypatch.setattr(inputs, "datagrams", lambda *_: seen)
    folder = tmp_path / "landed"
    queries._landed_datagrams(spark, SMALL, str(folder))
    assert read.value == 2 * 1000  # once for their number, once to deal them
    pieces = [pq.read_table(f)["seq"].to_pylist() for f in sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)]
    assert len(pieces) == 3 and sum(pieces, []) == sorted(r["seq"] for r in derived.collect())


def test_a_micro_batch_does_not_list_the_lake(spark, derived, tmp_path, monkeypatch):
    folder, catalogue = str(tmp_path), inputs.routes(spark, SMALL)
    tagged = quality.with_reject_reason(derived, catalogue)
    write_lake(quality.accepted(tagged), f"{folder}/bulk")

    def listing(*_):
        raise AssertionError("looks for its files in the whole lake")

    monkeypatch.setattr(lake_sink, "read_load", listing)
    ingest.archive_batch(tagged, 0, f"{folder}/lake", f"{folder}/rejects")
    months = spark.read.parquet(f"{folder}/lake/_trips").drop("load_id")
    same(months, spark.read.parquet(f"{folder}/bulk/_trips").drop("load_id"))


def test_the_chain_keeps_no_piece_of_state_for_every_shuffle_partition(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("chain-*"))
    assert queries.queries()["live_chain"](spark, SMALL).count() == 24
    (made,) = {f for f in shared.glob("chain-*") if (f / "accepted").exists()} - before
    # Where a query keeps state, its checkpoint has a folder for each partition, which every micro-batch loads and stores.
    of_streams = {f for f in shared.glob("chain-*/**/state/0/*")} - {f for b in before for f in b.glob("**/state/0/*")}
    assert made.exists() and not of_streams


def test_the_only_file_of_a_micro_batch_needs_no_prefix_sums(spark, routes, tmp_path, monkeypatch):
    (tmp_path / "lines").mkdir()
    line = "0,14-MAY-19,604118,70,34512345,-765310987,391,207,31,7300125588,2019-05-14 06:00:00,42"
    (tmp_path / "lines" / "a.csv").write_text(f"{line}\n{line}\n")

    def sums(*_):
        raise AssertionError("sums over one file")

    monkeypatch.setattr(ingest, "starts_of", sums)
    paths = [str(tmp_path / n) for n in ("lake", "rejects", "checkpoint")]
    ingest.ingest_lines(landing.stream_lines(spark, str(tmp_path / "lines"), 1), routes, *paths).awaitTermination()
    assert [r["seq"] for r in read_lake(spark, paths[0]).orderBy("seq").collect()] == [0, 1]


def test_delivery_by_subscriber(spark, reports_of_buses, zones, subscriptions, tmp_path):  # noqa: F811
    folder = str(tmp_path)
    reports_of_buses.coalesce(1).write.parquet(f"{folder}/landing")
    updates = vehicles.bus_update_stream(source(spark, f"{folder}/landing"), zones)
    delivery.write_deliveries(
        delivery.deliver_updates(updates, subscriptions), f"{folder}/inbox", f"{folder}/checkpoint"
    ).awaitTermination()
    inbox = spark.read.parquet(f"{folder}/inbox")
    expected = monitoring.updates_per_subscriber(monitoring.bus_updates(reports_of_buses, zones), subscriptions)
    same(inbox, expected.select("subscriber", "seq", "bus_id", "operational_state"))
    assert {r["seq"]: r["operational_state"] for r in inbox.where("subscriber = 'all'").collect()} == STATES
    alerts = vehicles.critical_alert_stream(source(spark, f"{folder}/landing"), zones)
    delivered = delivery.deliver_alerts(alerts, subscriptions)
    drain(delivered, f"{folder}/alerts")
    assert result(spark, delivered, f"{folder}/alerts").count() == 6


def test_board_is_replaced_per_batch(spark, derived, landed, tmp_path):
    folder, line_zones = str(tmp_path), inputs.line_zones(spark, SMALL)
    updates = monitoring.bus_updates(derived, line_zones)
    for piece in range(2):
        updates.where(F.col("seq") % 2 == piece).coalesce(1).write.mode("append").parquet(f"{folder}/updates")
    stream = landing.stream_datagrams(spark, f"{folder}/updates", 1, updates.schema)
    vehicles.publish_board(stream, f"{folder}/board", f"{folder}/checkpoint").awaitTermination()
    same(vehicles.read_board(spark, f"{folder}/board"), monitoring.status_board(updates))


def test_repeats_are_dropped(spark, derived, landed, tmp_path):
    land(derived, landed, 0, PIECES)  # the first part arrives again
    rows = vehicles.deduplicated(monitoring.consumable(source(spark, landed)))
    stream = rows.select("bus_id", "trip_id", "ts")
    drain(stream, str(tmp_path))
    same(
        result(spark, stream, str(tmp_path)),
        monitoring.consumable(derived).select("bus_id", "trip_id", "ts").distinct(),
    )


def test_throttled_alert_stream(spark, frame, tmp_path):
    folder = str(tmp_path)
    alerts = [datagram(i, 207, 1, at(s), 1, 1, bus, 50) for i, (s, bus) in enumerate([(0, 1), (4, 1), (5, 1), (4, 2), (900, 1), (901, 3)])]
    for part in (alerts[:4], alerts[4:5], alerts[5:]):
        frame(part).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    no_zones = spark.createDataFrame([], "line_id int, zone_id int")
    alerts_in = vehicles.critical_alert_stream(source(spark, f"{folder}/landing"), no_zones)
    vehicles.publish_throttled(alerts_in, f"{folder}/windows", f"{folder}/checkpoint").awaitTermination()
    windows = vehicles.read_throttled(spark, f"{folder}/windows").collect()
    found = {(r["bus_id"], r["window_start"], r["alerts"], r["first_seq"]) for r in windows}
    assert found == {(1, at(0), 2, 0), (1, at(5), 1, 2), (2, at(0), 1, 3), (1, at(900), 1, 4), (3, at(900), 1, 5)}


def test_many_files_in_one_batch_keep_apart(spark, routes, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    line = "0,14-MAY-19,604118,70,34512345,-765310987,391,207,31,7300125588,2019-05-14 06:00:00,42"
    for n in range(1500):
        (folder / f"{n:05d}.csv").write_text(f"{line}\n{line}\n")
    paths = [str(tmp_path / n) for n in ("lake", "rejects", "checkpoint")]
    ingest.ingest_lines(landing.stream_lines(spark, str(folder)), routes, *paths).awaitTermination()
    rows = read_lake(spark, paths[0]).agg(F.count("*"), F.countDistinct("seq"), F.max("seq")).first()
    assert rows[:2] == (3000, 3000) and 1499 * FILE_ROOM < rows[2] < 1501 * FILE_ROOM


def test_counters_add_up(spark, derived, landed, tmp_path):
    vehicles.publish_counters(source(spark, landed), str(tmp_path / "c"), str(tmp_path / "cp")).awaitTermination()
    per_batch = spark.read.parquet(str(tmp_path / "c"))
    assert per_batch.count() == PIECES
    total = per_batch.agg(F.sum("consumed"), F.sum("published"), F.sum("skipped")).first()
    empty = derived.where("bus_id = 0").count()
    assert tuple(total) == (1000 - empty, 1000 - empty, empty)


def test_schema_of_the_source(spark, landed):
    assert source(spark, landed).schema == DATAGRAM_SCHEMA


@pytest.mark.parametrize("slice_rows", [None, 20])
def test_carried_streams_equal_the_batch_forms(spark, derived, routes, landed, tmp_path, slice_rows):
    limits, line_zones = Limits(slice_rows=slice_rows), inputs.line_zones(spark, SMALL)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").drop("batch_id")
    to = lambda name: [f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", f"{tmp_path}/{name}-checkpoint"]

    carried.publish_states(source(spark, landed), line_zones, *to("states"), limits=limits).awaitTermination()
    zoned = monitoring.with_line_zone(monitoring.operational_state(monitoring.consumable(derived)), line_zones)
    same(read("states"), zoned.select(*monitoring.update_columns()))

    carried.publish_silences(source(spark, landed), *to("silences"), limits=limits).awaitTermination()
    same(read("silences"), monitoring.signal_gaps(monitoring.consumable(derived)))

    all_routes = inputs.routes(spark, SMALL)
    carried.publish_segments(source(spark, landed), all_routes, *to("segments"), limits=limits).awaitTermination()
    same(read("segments"), trip_segments(quality.valid_datagrams(derived, all_routes)))


def broadcasts(spark, run):
    """How many plans that ran meanwhile, as adaptive execution left them, sent a table through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        kept = store.executionsList()
        return [kept.apply(k) for k in range(kept.size())]

    # By number, as Spark keeps the last thousand only, so that their count stands still in a long session.
    before = max((e.executionId() for e in executions()), default=-1)
    run().awaitTermination()
    ran = "".join(e.physicalPlanDescription() for e in executions() if e.executionId() > before)
    assert "SortMergeJoin" in ran
    return ran.count("BroadcastExchange")


def dated(seq):
    return datagram(seq, 207, 1, datetime(2019, 5, 14, 6) + timedelta(seconds=50 * seq), 1, 1, seq % 2, event_type=9)


def test_unrepeated_sends_no_rows_through_the_driver(spark, frame, tmp_path):
    frame([dated(seq) for seq in range(1, 90)]).coalesce(1).write.parquet(f"{tmp_path}/landing")
    paths = [f"{tmp_path}/{n}" for n in ("kept", "aside", "state", "checkpoint")]
    stream = source(spark, f"{tmp_path}/landing")
    assert broadcasts(spark, lambda: carried.publish_unrepeated(stream, *paths, horizon_s=100)) == 0


def test_throttle_sends_no_windows_through_the_driver(spark, frame, tmp_path):
    frame([dated(seq) for seq in range(1, 90)]).coalesce(1).write.parquet(f"{tmp_path}/landing")
    paths = [f"{tmp_path}/{n}" for n in ("windows", "aside", "state", "checkpoint")]
    alerts = monitoring.critical_alerts(source(spark, f"{tmp_path}/landing").withColumn("zone_id", F.lit(1)))
    assert broadcasts(spark, lambda: carried.publish_throttled_within(alerts, *paths, horizon_s=100)) == 0


@pytest.mark.parametrize("pieces", [1, 4])
@pytest.mark.parametrize("slice_rows", [None, 7])
def test_unrepeated_does_not_depend_on_the_cut(spark, frame, tmp_path, pieces, slice_rows):
    rng = random.Random(3)
    rows = []
    for seq in range(1000):
        clock = 40 * (seq // 10) + rng.choice([0, 0, 0, -30, -90, -400])
        stamp = datetime(2019, 5, 14, 6) + timedelta(seconds=clock)
        rows.append(datagram(seq, 207, rng.choice([1, 2, None]), stamp, 1, 1, rng.choice([1, 1, 1, 2, 3])))
    newest, seen, expected = {}, set(), {"kept": [], "aside": []}
    for seq, *_, trip, _task, stamp, bus in rows:
        if bus in newest and stamp < newest[bus] - timedelta(seconds=100):
            expected["aside"].append(seq)
        elif (bus, stamp, trip) not in seen:
            expected["kept"].append(seq)
        seen.add((bus, stamp, trip))
        newest[bus] = max(stamp, newest.get(bus, stamp))
    for piece in range(pieces):
        land(frame(rows), f"{tmp_path}/landing", piece, pieces)
    paths = [f"{tmp_path}/{n}" for n in ("kept", "aside", "state", "checkpoint")]
    carried.publish_unrepeated(
        source(spark, f"{tmp_path}/landing"), *paths, horizon_s=100, limits=Limits(slice_rows=slice_rows)
    ).awaitTermination()
    for name, ids in expected.items():
        assert ids and sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == ids
    state = spark.read.parquet(f"{tmp_path}/state/slot={(pieces - 1) % 2}")
    ends = state.groupBy("bus_id").agg((F.max("ts") - F.min("ts")).alias("span")).collect()
    assert all(r["span"] <= timedelta(seconds=100) for r in ends) and state.count() < 200


def test_a_repeated_micro_batch_replaces_itself_and_a_lost_state_is_an_error(spark, frame, tmp_path):
    row = lambda seq: datagram(seq, 207, 1, f"2019-05-14 06:0{seq}:00", 1, 1, 1)
    state = f"{tmp_path}/state"
    for batch_id, value in ((0, 1), (1, 2), (1, 3)):
        carried._keep(frame([row(value)]), state, batch_id)
    (found,) = carried._carried(spark, state, 2, DATAGRAM_SCHEMA).collect()
    assert (found["seq"], found["ts"].minute) == (carried.EARLIER, 3)
    with pytest.raises(RuntimeError, match="does not hold the state"):
        carried._carried(spark, state, 4, DATAGRAM_SCHEMA)


def test_silent_trips_go_after_their_time(spark, frame, routes, tmp_path):
    rows = [
        datagram(0, 207, 1, "2019-05-14 06:00:00", 1, 1, 1),
        datagram(1, 207, 2, "2019-05-14 09:00:00", 1, 1, 1),
        datagram(2, 207, 3, "2019-05-14 01:00:00", 1, 1, 2),
    ]
    frame(rows).coalesce(1).write.parquet(f"{tmp_path}/landing")
    paths = [f"{tmp_path}/{n}" for n in ("out", "state", "checkpoint")]
    carried.publish_segments(source(spark, f"{tmp_path}/landing"), routes, *paths, keep_s=3600).awaitTermination()
    assert {r["trip_id"] for r in spark.read.parquet(f"{tmp_path}/state/slot=0").collect()} == {2, 3}


@pytest.mark.parametrize("pieces", [1, 4])
def test_throttled_windows_do_not_depend_on_the_cut(spark, frame, tmp_path, pieces):
    rng = random.Random(5)
    rows = []
    for seq in range(1000):
        clock = 20 * (seq // 10) + rng.choice([0, 3, -8, -40, -90, -400])
        stamp = datetime(2019, 5, 14, 6) + timedelta(seconds=clock)
        rows.append(datagram(seq, 207, 1, stamp, 1, 1, rng.choice([1, 1, 1, 2, None]), event_type=rng.randrange(3, 9)))
    newest, windows, aside = {}, {}, []
    for seq, event, *_, stamp, bus in rows:
        if bus in newest and stamp < newest[bus] - timedelta(seconds=100):
            aside.append(seq)
        else:
            start = stamp - timedelta(seconds=stamp.second % 30)
            windows.setdefault((bus, start), []).append((seq, event))
        newest[bus] = max(stamp, newest.get(bus, stamp))
    for piece in range(pieces):
        land(frame(rows), f"{tmp_path}/landing", piece, pieces)
    zones_of_lines = spark.createDataFrame([(207, 1)], "line_id int, zone_id int")
    alerts = monitoring.critical_alerts(monitoring.with_line_zone(source(spark, f"{tmp_path}/landing"), zones_of_lines))
    paths = [f"{tmp_path}/{n}" for n in ("windows", "aside", "state", "checkpoint")]
    carried.publish_throttled_within(alerts, *paths, horizon_s=100, window="30 seconds").awaitTermination()
    found = vehicles.read_throttled(spark, f"{tmp_path}/windows").collect()
    assert len(found) == len(windows)
    for row in found:
        held = windows[row["bus_id"], row["window_start"]]
        assert (row["alerts"], row["first_seq"]) == (len(held), held[0][0])
        assert row["description"].endswith(str(held[0][1]))
    assert aside and sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/aside").collect()) == aside
    assert spark.read.parquet(f"{tmp_path}/state/slot={(pieces - 1) % 2}").count() < len(windows) / 2
