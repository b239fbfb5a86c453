"""One query per operator, over the whole given tables.

Timestamps are shown as text and doubles are rounded, because sums of doubles depend on the
order of the rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcheck import inputs
from fleetspeed.functions import geo, text, timekeys
from fleetspeed.functions.timekeys import iso_text
from fleetspeed.operators import metrics, monitoring, quality, reports, segments, speed
from fleetspeed.plans import route_month
from fleetspeed.schema import Limits
from fleetspeed.session import prepare, work_folder
from fleetspeed.sinks import lake as lake_sink
from fleetspeed.sinks import results as result_sink
from fleetspeed.sinks.report_store import ReportStore
from fleetspeed.sources import archives
from fleetspeed.sources import datagrams as datagram_source
from fleetspeed.sources import lake as lake_source
from fleetspeed.sources import landing
from fleetspeed.sources import results as result_source
from fleetspeed.sources import routes as route_source
from fleetspeed.sources import zones
from fleetspeed.streaming import carried, delivery, ingest, vehicles

Query = Callable[[SparkSession, str], DataFrame]

RANGE = ((2018, 4), (2018, 8))
MONTH = (2018, 6)
NOW = "2018-06-04 07:20:00"
SHARDS = 4

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Shared parts


def _shown(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def _rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles rounded, timestamps as text; the order of the rows is kept."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "double":
            # Adding zero turns a negative zero into zero.
            columns.append((F.round(field.name, decimals) + F.lit(0.0)).alias(field.name))
        elif kind == "timestamp_ntz":
            columns.append(_shown(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return quality.valid_datagrams(inputs.datagrams(spark, sf), inputs.routes(spark, sf))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    return quality.with_reject_reason(inputs.datagrams(spark, sf), inputs.routes(spark, sf))


def _totals(spark: SparkSession, sf: str, mode: str = "normative") -> DataFrame:
    return speed.route_month_totals(segments.trip_segments(_valid(spark, sf), Limits(), mode))


def _report(spark: SparkSession, sf: str, mode: str = "normative") -> DataFrame:
    return speed.complete_report(_totals(spark, sf, mode), inputs.routes(spark, sf))


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return monitoring.bus_updates(inputs.datagrams(spark, sf), inputs.line_zones(spark, sf))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = monitoring.consumable(inputs.datagrams(spark, sf))
    return monitoring.critical_alerts(monitoring.with_line_zone(rows, inputs.line_zones(spark, sf)))


# Route-month speed


@query
def route_month_speed(spark, sf):
    report = route_month.speed_report(inputs.datagrams(spark, sf), inputs.routes(spark, sf))
    return _rounded(report)


@query
def route_month_speed_sorted(spark, sf):
    return _rounded(_report(spark, sf, "sorted"))


@query
def route_month_speed_arrival(spark, sf):
    return _rounded(_report(spark, sf, "arrival"))


@query
def partial_merge_by_bus_shard(spark, sf):
    closed = segments.trip_segments(_valid(spark, sf))
    shard = lake_sink.shard_of(F.col("bus_id"), SHARDS)
    parts = speed.route_month_totals(closed.withColumn("shard", shard), "shard")
    return _rounded(speed.complete_report(speed.merged_totals(parts), inputs.routes(spark, sf)))


@query
def month_range_report(spark, sf):
    first, last = (timekeys.month_text(*m) for m in RANGE)
    return _rounded(speed.range_report(_totals(spark, sf), inputs.routes(spark, sf), first, last))


@query
def single_month_report(spark, sf):
    return _rounded(
        speed.month_report(_totals(spark, sf), inputs.routes(spark, sf), timekeys.month_text(*MONTH))
    )


@query
def named_route_report(spark, sf):
    # Without the catalogue filter, so lines outside the catalogue get placeholder names.
    rows = inputs.datagrams(spark, sf).where(quality.plausible())
    totals = speed.route_month_totals(segments.trip_segments(rows))
    return _rounded(speed.named_report(totals, inputs.routes(spark, sf)))


@query
def observed_months(spark, sf):
    return speed.observed_months(_valid(spark, sf))


@query
def run_metrics(spark, sf):
    return metrics.run_metrics(_tagged(spark, sf), segments.trip_segments(_valid(spark, sf)))


@query
def measured_run(spark, sf):
    """Counters of a run that is measured while it writes its report; times are only held to make sense."""
    report = lambda cut: speed.complete_report(speed.route_month_totals(cut), inputs.routes(spark, sf))
    row = metrics.measured_run(
        spark, _tagged(spark, sf), segments.trip_segments, report, work_folder(spark, "measured"), "spark", "events"
    )
    fits = F.abs(F.col("rows_per_second") * F.col("elapsed_ms") / 1000 - F.col("processed_rows")) < 1
    return row.select(
        "processed_rows", "valid_rows", "skipped_rows", "result_rows", (fits & (F.col("memory_mb") > 0)).alias("measured")
    )


@query
def partition_metrics(spark, sf):
    return speed.partition_metrics(segments.trip_segments(_valid(spark, sf), mode="arrival"))


@query
def haversine_segments(spark, sf):
    return _rounded(segments.segment_table(segments.trip_segments(_valid(spark, sf))))


# Validation


@query
def valid_datagrams(spark, sf):
    rows = _valid(spark, sf)
    return _rounded(
        rows.select(
            "seq",
            "bus_id",
            "line_id",
            "trip_id",
            geo.degrees_of(F.col("raw_lat")).alias("lat"),
            geo.degrees_of(F.col("raw_lon")).alias("lon"),
            "ts",
        ),
        7,
    )


@query
def inactive_line_datagrams(spark, sf):
    rows = quality.off_active_route(inputs.datagrams(spark, sf), inputs.routes(spark, sf))
    return rows.select("seq", "bus_id", "line_id")


@query
def rejects_by_reason(spark, sf):
    return quality.rejects_by_reason(_tagged(spark, sf))


@query
def reject_sample(spark, sf):
    return quality.reject_sample(_tagged(spark, sf))


@query
def accept_reject_split(spark, sf):
    return quality.accept_reject_counts(_tagged(spark, sf))


@query
def accept_reject_rows(spark, sf):
    """Both sides of the split, row by row."""
    tagged = _tagged(spark, sf)
    kept = quality.accepted(tagged).select("seq", "line_id", F.lit("accepted").alias("reason"))
    return kept.unionByName(quality.rejected(tagged).select("seq", "line_id", F.col(quality.REJECT).alias("reason")))


@query
def input_cap(spark, sf):
    return quality.first_rows(inputs.datagrams(spark, sf).select("seq", "bus_id", "line_id"), 500)


@query
def empty_record_guard(spark, sf):
    date_text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kept = quality.has_content(date_text, F.col("bus_id"))
    return inputs.datagrams(spark, sf).groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


# Text


@query
def csv_parse_roundtrip(spark, sf):
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf))
    return _rounded(datagram_source.readable(datagram_source.parse_lines(lines)))


@query
def csv_parse_errors(spark, sf):
    parsed = datagram_source.parse_lines(inputs.datagram_lines(inputs.datagrams(spark, sf)))
    return parsed.groupBy(F.coalesce("parse_error", F.lit("NONE")).alias("parse_error")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def csv_file_scan(spark, sf):
    """Lines written to files in arrival order and scanned back: order and fields survive."""
    folder = work_folder(spark, "lines")
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf))
    lines.orderBy("seq").select("value").write.text(folder)
    scanned = datagram_source.scan_datagrams(spark, folder)
    valid = quality.valid_datagrams(scanned, inputs.routes(spark, sf))
    totals = speed.route_month_totals(segments.trip_segments(valid))
    return _rounded(speed.complete_report(totals, inputs.routes(spark, sf)))


@query
def route_catalogue_scan(spark, sf):
    """Catalogue written as CSV with extra columns, bad rows and a stale duplicate first."""
    folder = work_folder(spark, "routes")
    catalogue = inputs.routes(spark, sf)
    row = F.concat_ws(
        ",", F.col("line_id").cast("string"), F.lit("1"), text.quoted(F.col("short_name")), text.quoted(F.col("description"))
    )
    stale = F.concat_ws(",", F.col("line_id").cast("string"), F.lit("1"), F.lit("old"), F.lit("old"))
    head = spark.range(1).select(
        F.lit(0).alias("part"), F.lit(0).alias("line_id"), F.lit(" LineId ,PLANVERSIONID,ShortName,DESCRIPTION").alias("value")
    )
    body = head.unionByName(catalogue.select(F.lit(1).alias("part"), "line_id", stale.alias("value")))
    body = body.unionByName(catalogue.select(F.lit(2).alias("part"), "line_id", F.lit("bad,row").alias("value")))
    body = body.unionByName(catalogue.select(F.lit(3).alias("part"), "line_id", row.alias("value")))
    body.orderBy("part", "line_id").select("value").write.text(folder)
    return route_source.read_routes(spark, folder)


@query
def zone_map_scan(spark, sf):
    """The zone map written as one JSON object and read back."""
    folder = work_folder(spark, "zones")
    pair = F.struct(F.col("line_id").cast("string"), "zone_id")
    lines = inputs.line_zones(spark, sf).agg(F.map_from_entries(F.collect_list(pair)).alias("lineToZone"))
    lines.select(F.to_json(F.struct("lineToZone")).alias("value")).write.text(folder)
    return zones.read_zone_maps(spark, folder)[0]


@query
def month_inference(spark, sf):
    patterns = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm")
    shapes = [F.date_format("ts", p) for p in patterns] + [F.lit("invalid-date"), F.lit("")]
    stamp = F.element_at(F.array(*shapes), (F.col("seq") % 5 + 1).cast("int"))
    rows = inputs.datagrams(spark, sf).select("seq", stamp.alias("stamp"))
    return rows.select("seq", timekeys.inferred_month(F.col("stamp"), "2018-01").alias("year_month"))


@query
def iso_timestamps(spark, sf):
    return inputs.datagrams(spark, sf).select("seq", iso_text(F.col("ts")).alias("ts_text"))


@query
def speed_band(spark, sf):
    kmh = F.when(F.col("seq") % 7 != 0, F.col("seq") % 21 + 0.5)
    rows = inputs.datagrams(spark, sf).select("seq", kmh.alias("kmh"))
    return rows.select("seq", geo.speed_band(F.col("kmh")).alias("band"))


# Report queries


def _stored_report(spark: SparkSession, sf: str) -> ReportStore:
    """The report in a store, its months written in two parts."""
    store, report = ReportStore(spark, work_folder(spark, "store")), _report(spark, sf)
    store.replace_months(report.where(F.col("year_month") < timekeys.month_text(*MONTH)))
    store.replace_months(report.where(F.col("year_month") >= timekeys.month_text(*MONTH)))
    return store


@query
def report_point(spark, sf):
    return _rounded(_stored_report(spark, sf).point(101, *MONTH))


@query
def report_month(spark, sf):
    return _rounded(_stored_report(spark, sf).monthly(*MONTH))


@query
def report_range(spark, sf):
    return _rounded(_stored_report(spark, sf).in_range((2018, 6), (2018, 12)))


@query
def report_upsert(spark, sf):
    store = _stored_report(spark, sf)
    store.upsert(reports.monthly(_report(spark, sf, "sorted"), *MONTH))
    return _rounded(store.read())


@query
def report_first_version(spark, sf):
    """What the store held before the upsert, after it was restored."""
    store = _stored_report(spark, sf)
    before = store.versions()[-1]
    store.upsert(reports.monthly(_report(spark, sf, "sorted"), *MONTH))
    store.restore(before)
    return _rounded(store.read())


@query
def report_table(spark, sf):
    return _rounded(_stored_report(spark, sf).comparison(*RANGE))


@query
def report_delta(spark, sf):
    return _rounded(reports.month_deltas(_report(spark, sf)))


@query
def report_of_routes(spark, sf):
    return _rounded(reports.of_routes(_report(spark, sf), [100, 102, 104, -1, 110]))


@query
def report_preview(spark, sf):
    return _rounded(reports.preview(_report(spark, sf)))


@query
def report_store_order(spark, sf):
    return _rounded(reports.store_order(_report(spark, sf)))


@query
def run_summary(spark, sf):
    return reports.run_summary(_report(spark, sf))


@query
def report_json(spark, sf):
    return _rounded(_report(spark, sf)).select(
        "line_id", "year_month", result_sink.report_json().alias("json")
    )


@query
def report_json_array(spark, sf):
    return result_sink.reports_json_array(_rounded(_report(spark, sf)))


@query
def report_json_chunks(spark, sf):
    """The array of all reports in texts of at most 40 rows."""
    return result_sink.reports_json_chunks(_rounded(_report(spark, sf)), 40)


@query
def speed_csv_lines(spark, sf):
    return result_sink.speed_csv(_report(spark, sf))


@query
def speed_csv_roundtrip(spark, sf):
    folder = work_folder(spark, "speed-csv")
    result_sink.write_store(_report(spark, sf), folder)
    return _rounded(result_source.read_speed_results(spark, folder))


@query
def metrics_csv(spark, sf):
    counters = metrics.run_metrics(_tagged(spark, sf), segments.trip_segments(_valid(spark, sf)))
    row = metrics.run_metrics_row(counters, "spark", "events", elapsed_ms=2000, result_rows=75)
    return result_sink.metrics_csv(row)


@query
def result_reconcile(spark, sf):
    return _rounded(reports.reconcile(_report(spark, sf, "arrival"), _report(spark, sf)))


@query
def union_parts(spark, sf):
    """Months computed apart and put together again."""
    totals, catalogue = _totals(spark, sf), inputs.routes(spark, sf)
    months = [speed.month_report(totals, catalogue, m) for m in ("2018-05", "2018-06", "2018-07")]
    return _rounded(months[0].unionByName(months[1]).unionByName(months[2]))


# Real-time rules in batch form


@query
def event_category(spark, sf):
    rows = inputs.datagrams(spark, sf)
    return rows.select("seq", "event_type", monitoring.event_category().alias("category"))


@query
def operational_state(spark, sf):
    rows = monitoring.consumable(inputs.datagrams(spark, sf))
    return monitoring.operational_state(rows).select("seq", "bus_id", "operational_state")


@query
def bus_updates(spark, sf):
    return _rounded(_updates(spark, sf), 7)


@query
def critical_alerts(spark, sf):
    return _rounded(_alerts(spark, sf))


@query
def alert_history(spark, sf):
    return _rounded(monitoring.alert_history(_alerts(spark, sf)))


@query
def signal_gaps(spark, sf):
    return _rounded(monitoring.signal_gaps(monitoring.consumable(inputs.datagrams(spark, sf))))


@query
def signal_lost_asof(spark, sf):
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = monitoring.consumable(inputs.datagrams(spark, sf))
    return _rounded(monitoring.signal_lost_as_of(rows, now))


@query
def latest_bus_state(spark, sf):
    return _rounded(monitoring.latest_bus_state(_updates(spark, sf)), 7).drop("seq")


@query
def fleet_status(spark, sf):
    return monitoring.fleet_status(_updates(spark, sf))


@query
def status_board(spark, sf):
    return monitoring.status_board(_updates(spark, sf))


@query
def live_map_filter(spark, sf):
    chosen = monitoring.map_filter(
        _updates(spark, sf), [100, 101, 102, 103], 1, "2018-05-31 23:00:00", "2018-06-01 12:00:00"
    )
    return _rounded(chosen, 7)


@query
def bus_detail(spark, sf):
    return _rounded(monitoring.bus_detail(_updates(spark, sf), 3), 7).drop("seq")


@query
def line_zone(spark, sf):
    rows = inputs.datagrams(spark, sf).select("seq", "line_id")
    return monitoring.with_line_zone(rows, inputs.line_zones(spark, sf))


@query
def user_zone(spark, sf):
    # Customers are users without a zone of their own.
    users = inputs.table(spark, sf, "supplier").select(F.col("s_name").alias("user_id")).unionAll(
        inputs.table(spark, sf, "customer").select(F.col("c_name").alias("user_id"))
    )
    return monitoring.with_user_zone(users, inputs.user_zones(spark, sf))


@query
def subscription_fanout(spark, sf):
    delivered = monitoring.updates_per_subscriber(
        _updates(spark, sf).select("seq", "bus_id", "zone_id", "operational_state"),
        inputs.subscriptions(spark, sf),
    )
    return delivered.select("subscriber", "seq", "bus_id", "zone_id", "operational_state")


@query
def alert_fanout(spark, sf):
    # Half of the alerts get a lower priority, so both delivery rules take part.
    lower = F.when(F.col("seq") % 2 == 0, F.lit("BAJA")).otherwise(F.col("priority"))
    delivered = monitoring.alerts_per_subscriber(
        _alerts(spark, sf).withColumn("priority", lower), inputs.subscriptions(spark, sf)
    )
    return delivered.select("subscriber", "seq", "zone_id", "priority")


@query
def delivery_counts(spark, sf):
    return monitoring.delivery_counts(
        _updates(spark, sf), _alerts(spark, sf), inputs.subscriptions(spark, sf)
    )


def _deliveries(spark: SparkSession, sf: str) -> DataFrame:
    mixed = _alerts(spark, sf).withColumn("priority", F.when(F.col("seq") % 2 == 0, "BAJA").otherwise(F.col("priority")))
    return monitoring.zone_deliveries(_updates(spark, sf), mixed)


@query
def zone_deliveries(spark, sf):
    return _deliveries(spark, sf)


@query
def supplier_inbox_counts(spark, sf):
    """What every supplier gets, by the latest version of what they listen to."""
    people = monitoring.current_subscriptions(inputs.supplier_subscriptions(spark, sf))
    return monitoring.inbox_counts(_deliveries(spark, sf), people)


@query
def supplier_inbox(spark, sf):
    """The inbox of one supplier, resolved when it is read."""
    people = monitoring.current_subscriptions(inputs.supplier_subscriptions(spark, sf))
    return monitoring.inbox(_deliveries(spark, sf), people, "Supplier#000000006")


@query
def update_speed_enriched(spark, sf):
    enriched = monitoring.with_month_speed(
        _updates(spark, sf), _report(spark, sf), timekeys.month_text(*MONTH)
    )
    return _rounded(enriched.select("seq", "bus_id", "line_id", "year_month", "line_speed_kmh"))


@query
def alert_last_position(spark, sf):
    placed = monitoring.alerts_with_position(_alerts(spark, sf), _updates(spark, sf))
    return _rounded(placed.select("seq", "bus_id", "line_id", "lat", "lon"), 7)


@query
def stream_counters_batch(spark, sf):
    return metrics.stream_counters(inputs.datagrams(spark, sf))


# Lake


def _lake(spark: SparkSession, sf: str) -> str:
    folder = work_folder(spark, "lake")
    lake_sink.write_lake(_valid(spark, sf), folder)
    return folder


@query
def lake_roundtrip(spark, sf):
    rows = lake_source.read_lake(spark, _lake(spark, sf))
    return _rounded(rows.select("seq", "bus_id", "line_id", "trip_id", "year", "month", "ts"))


@query
def lake_partitions(spark, sf):
    return lake_source.lake_partitions(spark, _lake(spark, sf))


@query
def lake_partition_scan(spark, sf):
    rows = lake_source.lake_partition(spark, _lake(spark, sf), -1, *MONTH)
    return _rounded(rows.select("seq", "bus_id", "trip_id", "ts"))


@query
def lake_range_report(spark, sf):
    report = route_month.run_range(
        spark, _lake(spark, sf), inputs.routes(spark, sf), *RANGE
    )
    return _rounded(report)


@query
def lake_month_report(spark, sf):
    return _rounded(route_month.run_month(spark, _lake(spark, sf), inputs.routes(spark, sf), *MONTH))


def _loaded_report(spark: SparkSession, sf: str, lake: str) -> DataFrame:
    routes = inputs.routes(spark, sf)
    totals = speed.route_month_totals(segments.trip_segments(lake_source.read_lake(spark, lake)))
    return _rounded(speed.complete_report(totals, routes))


@query
def lake_two_loads(spark, sf):
    """Lines in two bulk loads, the second one behind the first: the report of all of them."""
    folder, half = work_folder(spark, "loads"), inputs.table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf))
    for name, part in (("first", lines.where(F.col("seq") <= half)), ("second", lines.where(F.col("seq") > half))):
        part.repartitionByRange(2, "seq").sortWithinPartitions("seq").select("value").write.text(f"{folder}/{name}")
        route_month.build_lake(spark, inputs.routes(spark, sf), f"{folder}/lake", f"{folder}/{name}")
    return _loaded_report(spark, sf, f"{folder}/lake")


@query
def lake_bulk_then_stream(spark, sf):
    """The first half as a bulk load, the rest as micro-batches of raw lines into the same lake."""
    folder, half = work_folder(spark, "loads"), inputs.table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2
    routes = inputs.routes(spark, sf)
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf).where(F.col("seq") <= half))
    lines.repartitionByRange(2, "seq").sortWithinPartitions("seq").select("value").write.text(f"{folder}/bulk")
    route_month.build_lake(spark, routes, f"{folder}/lake", f"{folder}/bulk")
    stream = _landed_lines(spark, sf, f"{folder}/live", f"seq > {half}")
    paths = (f"{folder}/lake", f"{folder}/rejects", f"{folder}/checkpoint")
    ingest.ingest_lines(stream, routes, *paths).awaitTermination()
    return _loaded_report(spark, sf, f"{folder}/lake")


@query
def live_chain(spark, sf):
    """Raw lines to accepted datagrams in one stream, and from those to bus updates in the next.

    The states of the buses are carried as rows: keyed state would load and store one piece for every shuffle partition in
    every micro-batch, and both grow with the input.
    """
    folder, routes = work_folder(spark, "chain"), inputs.routes(spark, sf)
    stream = _landed_lines(spark, sf, f"{folder}/live", "true")
    paths = (f"{folder}/lake", f"{folder}/rejects", f"{folder}/checkpoint")
    ingest.ingest_lines(stream, routes, *paths, accepted=f"{folder}/accepted").awaitTermination()
    accepted = landing.stream_datagrams(spark, f"{folder}/accepted", files_per_trigger=1)
    told = [f"{folder}/{n}" for n in ("updates", "states", "updates-checkpoint")]
    carried.publish_states(accepted, inputs.line_zones(spark, sf), *told).awaitTermination()
    found = spark.read.parquet(told[0])
    return found.groupBy("bus_id", "line_id", "operational_state").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_scan(spark, sf):
    """Lines packed into zip archives and unpacked again: order and fields survive."""
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf))
    path = F.format_string("part-%012d.zip", F.floor(F.col("seq") / 2000))
    packed = lines.groupBy(path.alias("path")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n").alias("text")
    )
    landed = archives.unpacked(packed.mapInArrow(_zipped, "path string, content binary"))
    valid = quality.valid_datagrams(
        datagram_source.readable(datagram_source.parse_lines(archives.stamp_landed(landed))), inputs.routes(spark, sf)
    )
    totals = speed.route_month_totals(segments.trip_segments(valid))
    return _rounded(speed.complete_report(totals, inputs.routes(spark, sf)))


def _zipped(batches):
    for batch in batches:
        contents = []
        for text_of_file in batch["text"].to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("lines.csv", text_of_file)
            contents.append(held.getvalue())
        yield pa.RecordBatch.from_arrays([batch["path"], pa.array(contents, pa.binary())], ["path", "content"])


@query
def range_result_file(spark, sf):
    """The result file of a range run, read back."""
    folder = work_folder(spark, "range")
    report = route_month.run_range(spark, _lake(spark, sf), inputs.routes(spark, sf), *RANGE)
    route_month.write_range(report, folder)
    return _rounded(result_source.read_speed_results(spark, folder))


@query
def bus_shards(spark, sf):
    folder = work_folder(spark, "shards")
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf))
    lake_sink.write_shards(lines, folder, SHARDS)
    shards = spark.read.option("basePath", folder).text(folder)
    return shards.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_lines")
    )


@query
def bus_shard_rows(spark, sf):
    """Every line of the shards, read back and parsed."""
    folder = work_folder(spark, "shards")
    lake_sink.write_shards(inputs.datagram_lines(inputs.datagrams(spark, sf)), folder, SHARDS)
    rows = datagram_source.parse_lines(spark.read.option("basePath", folder).text(folder))
    return rows.select("shard", "unknown1", "line_id", "trip_id", "bus_id", "raw_lat", "raw_lon", _shown())


# Streams, replayed over the events table until all of it is consumed


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = inputs.table(spark, sf, "events").schema
    # A pattern, so that the table may be one file or a folder of files.
    raw = landing.stream_datagrams(spark, f"{sf}/events.parque[t]", schema=schema)
    return inputs.as_datagrams(raw)


def _pieces(spark: SparkSession, rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """Rows in consecutive pieces, each in arrival order and one task, to be landed as one file after another.

    All rows are dealt by piece in one pass; a scan of the table for each piece would grow with its square.
    """
    low, high, n = rows.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    width = (high - low) // max(3, n // 200_000) + 1
    dealt = rows.withColumn("piece", F.expr(f"(seq - {low}) div {width}"))
    dealt.repartition("piece").write.partitionBy("piece").parquet(folder)
    held = spark.read.schema(dealt.schema).parquet(folder)
    for k in range((high - low) // width + 1):
        yield held.where(F.col("piece") == k).drop("piece").coalesce(1).sortWithinPartitions("seq")


def _landed_lines(spark: SparkSession, sf: str, folder: str, condition: str) -> DataFrame:
    """Lines of some rows, landed file after file in arrival order, as a stream of one file a micro-batch."""
    lines = inputs.datagram_lines(inputs.datagrams(spark, sf).where(condition))
    for piece in _pieces(spark, lines, f"{folder}-dealt"):
        piece.select("value").write.mode("append").text(folder)
    return landing.stream_lines(spark, folder, files_per_trigger=1)


def _landed_datagrams(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """All datagrams, landed file after file in arrival order, as a stream of one file a micro-batch."""
    for piece in _pieces(spark, inputs.datagrams(spark, sf), f"{folder}-dealt"):
        piece.write.mode("append").parquet(folder)
    return landing.stream_datagrams(spark, folder, files_per_trigger=1)


def _drained(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Run an append stream over all that has landed and read what it wrote."""
    folder = work_folder(spark, purpose)
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_updates_replay(spark, sf):
    stream = vehicles.bus_update_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf))
    return _rounded(_drained(spark, stream, "updates"), 7)


@query
def stream_alerts_replay(spark, sf):
    stream = vehicles.critical_alert_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf))
    return _rounded(_drained(spark, stream, "alerts"))


@query
def stream_publish_replay(spark, sf):
    folder = work_folder(spark, "publish")
    vehicles.publish(
        _events_stream(spark, sf),
        inputs.line_zones(spark, sf),
        f"{folder}/updates",
        f"{folder}/alerts",
        f"{folder}/checkpoint",
    ).awaitTermination()
    counts = []
    for name in ("updates", "alerts"):
        rows = spark.read.parquet(f"{folder}/{name}")
        counts.append(rows.groupBy("bus_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name)))
    return counts[0].unionByName(counts[1])


@query
def stream_publish_rows(spark, sf):
    """Every published update and alert."""
    folder = work_folder(spark, "publish")
    vehicles.publish(
        _events_stream(spark, sf), inputs.line_zones(spark, sf), f"{folder}/updates", f"{folder}/alerts", f"{folder}/checkpoint"
    ).awaitTermination()
    updates, alerts = (spark.read.parquet(f"{folder}/{name}") for name in ("updates", "alerts"))
    none = F.lit(None).cast("int")
    return updates.select("seq", "bus_id", "zone_id", "operational_state", none.alias("event_type")).unionByName(
        alerts.select("seq", "bus_id", "zone_id", F.lit("ALERT").alias("operational_state"), "event_type")
    )


@query
def stream_signal_loss_replay(spark, sf):
    rows = monitoring.consumable(_events_stream(spark, sf))
    return _rounded(_drained(spark, vehicles.signal_loss_stream(rows, live=False), "signal"))


@query
def stream_segments_replay(spark, sf):
    stream = vehicles.trip_segment_stream(_events_stream(spark, sf), inputs.routes(spark, sf))
    totals = speed.route_month_totals(_drained(spark, stream, "segments"))
    return _rounded(speed.complete_report(totals, inputs.routes(spark, sf)))


@query
def carried_updates(spark, sf):
    """Updates of a stream whose bus states are carried as rows."""
    folder = work_folder(spark, "carried")
    stream, zones = _landed_datagrams(spark, sf, f"{folder}/landed"), inputs.line_zones(spark, sf)
    carried.publish_states(stream, zones, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return _rounded(spark.read.parquet(f"{folder}/out").drop("batch_id"), 7)


@query
def carried_silences(spark, sf):
    folder = work_folder(spark, "carried")
    stream = _landed_datagrams(spark, sf, f"{folder}/landed")
    carried.publish_silences(stream, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return _rounded(spark.read.parquet(f"{folder}/out").drop("batch_id"))


@query
def carried_segments(spark, sf):
    folder, routes = work_folder(spark, "carried"), inputs.routes(spark, sf)
    stream = _landed_datagrams(spark, sf, f"{folder}/landed")
    carried.publish_segments(
        stream, routes, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint"
    ).awaitTermination()
    totals = speed.route_month_totals(spark.read.parquet(f"{folder}/out").drop("batch_id"))
    return _rounded(speed.complete_report(totals, routes))


@query
def carried_unrepeated(spark, sf):
    """First arrivals of reports, and those an hour or more behind their bus, set aside."""
    folder = work_folder(spark, "carried")
    stream = _landed_datagrams(spark, sf, f"{folder}/landed")
    names = [f"{folder}/{n}" for n in ("kept", "aside", "state", "checkpoint")]
    carried.publish_unrepeated(stream, *names, horizon_s=3600).awaitTermination()
    parts = [spark.read.parquet(f"{folder}/{n}").select("seq", "bus_id", F.lit(n).alias("what")) for n in ("kept", "aside")]
    return parts[0].unionByName(parts[1])


@query
def carried_throttle(spark, sf):
    """Alert windows of 10 minutes; alerts a day or more behind their bus are set aside."""
    folder, zones = work_folder(spark, "carried"), inputs.line_zones(spark, sf)
    alerts = vehicles.critical_alert_stream(_landed_datagrams(spark, sf, f"{folder}/landed"), zones)
    names = [f"{folder}/{n}" for n in ("windows", "aside", "state", "checkpoint")]
    carried.publish_throttled_within(alerts, *names, horizon_s=86_400, window="10 minutes").awaitTermination()
    return _rounded(vehicles.read_throttled(spark, f"{folder}/windows"))


@query
def stream_ingest_replay(spark, sf):
    folder = work_folder(spark, "ingest")
    ingest.ingest_datagrams(
        _events_stream(spark, sf),
        inputs.routes(spark, sf),
        f"{folder}/lake",
        f"{folder}/rejects",
        f"{folder}/checkpoint",
    ).awaitTermination()
    kept = spark.read.parquet(f"{folder}/lake").groupBy("line_id").agg(F.count(F.lit(1)).alias("n"))
    lost = spark.read.parquet(f"{folder}/rejects").groupBy(quality.REJECT).agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.concat(F.lit("line "), F.col("line_id")).alias("what"), "n").unionByName(
        lost.select(F.concat(F.lit("reject "), F.col(quality.REJECT)).alias("what"), "n")
    )


@query
def stream_ingest_rows(spark, sf):
    """Every row that the ingest stream kept or rejected."""
    folder = work_folder(spark, "ingest")
    ingest.ingest_datagrams(
        _events_stream(spark, sf), inputs.routes(spark, sf), f"{folder}/lake", f"{folder}/rejects", f"{folder}/checkpoint"
    ).awaitTermination()
    kept = lake_source.read_lake(spark, f"{folder}/lake").select("seq", "line_id", F.lit("accepted").alias("reason"))
    lost = spark.read.parquet(f"{folder}/rejects").select("seq", "line_id", F.col(quality.REJECT).alias("reason"))
    return kept.unionByName(lost)


@query
def stream_fanout_replay(spark, sf):
    updates = vehicles.bus_update_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf))
    delivered = delivery.deliver_updates(
        updates.select("seq", "bus_id", "zone_id"), inputs.subscriptions(spark, sf)
    )
    return _drained(spark, delivered, "fanout").select("subscriber", "seq", "bus_id", "zone_id")


@query
def stream_enriched_replay(spark, sf):
    updates = vehicles.bus_update_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf))
    folder = work_folder(spark, "reports")
    _report(spark, sf).write.parquet(folder)
    enriched = delivery.enriched_updates(
        updates, spark.read.parquet(folder), timekeys.month_text(*MONTH)
    ).select("seq", "line_id", "year_month", "line_speed_kmh")
    return _rounded(_drained(spark, enriched, "enriched"))


@query
def stream_status_board(spark, sf):
    folder = work_folder(spark, "board")
    # The board stream reads the published updates, as a client of them would.
    updates = _drained(
        spark,
        vehicles.bus_update_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf)),
        "board-updates",
    )
    source = landing.stream_datagrams(
        spark, updates.inputFiles()[0].rsplit("/", 1)[0], schema=updates.schema
    )
    vehicles.publish_board(source, f"{folder}/board", f"{folder}/checkpoint").awaitTermination()
    return vehicles.read_board(spark, f"{folder}/board")


@query
def stream_deduplicated(spark, sf):
    rows = vehicles.deduplicated(monitoring.consumable(_events_stream(spark, sf)))
    return _drained(spark, rows.select("bus_id", "trip_id", "ts"), "dedup").select(
        "bus_id", "trip_id", _shown()
    )


@query
def alert_throttle(spark, sf):
    return _rounded(vehicles.throttled_alerts(_alerts(spark, sf), window="10 minutes"))


@query
def stream_alert_throttle(spark, sf):
    folder = work_folder(spark, "throttle")
    alerts = vehicles.critical_alert_stream(_events_stream(spark, sf), inputs.line_zones(spark, sf))
    vehicles.publish_throttled(
        alerts, f"{folder}/windows", f"{folder}/checkpoint", window="10 minutes"
    ).awaitTermination()
    return _rounded(vehicles.read_throttled(spark, f"{folder}/windows"))


@query
def stream_counters(spark, sf):
    folder = work_folder(spark, "counters")
    vehicles.publish_counters(
        _events_stream(spark, sf), f"{folder}/counters", f"{folder}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/counters").agg(
        *[F.sum(c).alias(c) for c in ("consumed", "published", "skipped")]
    )


