"""The SQL twin of every query, written independently of the Spark operators.

Segmentation is spelled out as filter-then-lag here, while the Spark side uses one running
maximum, so that the two check each other.
"""

from __future__ import annotations

from fleetcheck.inputs import DATAGRAM_EXPRS, OFFSET_EXPR, ROUTE_LINE_EXPR

_COLS = ", ".join(f"{sql} AS {name}" for name, sql in DATAGRAM_EXPRS.items())
_TRIP = "bus_id, line_id, trip_id"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_DATAGRAMS = f"""
d AS (SELECT {_COLS},
        TIMESTAMP '2018-05-31 20:00:00' + to_seconds(CAST({OFFSET_EXPR} AS BIGINT)) AS ts
      FROM events),
routes AS (SELECT {ROUTE_LINE_EXPR} AS line_id, n_name AS short_name, r_name AS description
           FROM nation JOIN region ON n_regionkey = r_regionkey),
zones AS (SELECT {ROUTE_LINE_EXPR} AS line_id, CAST(n_regionkey AS INT) AS zone_id
          FROM nation),
plausible AS (SELECT d.*, raw_lat / 1e7 AS lat, raw_lon / 1e7 AS lon, strftime(ts, '%Y-%m') AS year_month
              FROM d WHERE raw_lat <> -1 AND raw_lon <> -1 AND bus_id > 0 AND trip_id >= 0
                AND ts IS NOT NULL),
valid AS (SELECT * FROM plausible WHERE line_id IN (SELECT line_id FROM routes)),
tagged AS (SELECT d.*, CASE WHEN raw_lat = -1 THEN 'LAT_MINUS_ONE' WHEN raw_lon = -1 THEN 'LON_MINUS_ONE'
             WHEN bus_id <= 0 THEN 'BUSID_NONPOSITIVE' WHEN trip_id < 0 THEN 'TRIPID_NEGATIVE'
             WHEN line_id NOT IN (SELECT line_id FROM routes) THEN 'LINEID_NOT_ACTIVE' END AS reason
           FROM d)"""

_KM = (
    "2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2)"
    " + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"
)


def _segments(name: str, source: str) -> str:
    """Normative segmentation of ``source``."""
    return f"""
{name}_seen AS (SELECT *, max(ts) OVER (PARTITION BY {_TRIP} ORDER BY seq {_BEFORE}) AS newest FROM {source}),
{name}_flag AS (SELECT *, coalesce(ts <= newest, false) AS late FROM {name}_seen),
{name}_kept AS (SELECT seq, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
    FROM {name}_flag WHERE NOT late WINDOW w AS (PARTITION BY {_TRIP} ORDER BY seq)),
{name}_gap AS (SELECT f.*, date_diff('second', pts, ts) AS gap_s, {_KM} AS km
    FROM {name}_flag f LEFT JOIN {name}_kept k USING (seq)),
{name} AS (SELECT *, CASE WHEN gap_s IS NULL THEN NULL
      ELSE gap_s > 0 AND gap_s <= 300 AND km / (gap_s / 3600.0) <= 120 END AS ok FROM {name}_gap)"""


def _month_segments(name: str, order: str) -> str:
    """Segmentation within one line and month, in time or arrival order."""
    return f"""
{name}_pair AS (SELECT *, false AS late, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
    FROM valid WHERE line_id <> -1 WINDOW w AS (PARTITION BY {_TRIP}, year_month ORDER BY {order})),
{name}_gap AS (SELECT *, date_diff('second', pts, ts) AS gap_s, {_KM} AS km FROM {name}_pair),
{name} AS (SELECT *, CASE WHEN gap_s IS NULL THEN NULL WHEN gap_s <= 0 OR gap_s > 300 THEN false
      ELSE km / (gap_s / 3600.0) <= 120 END AS ok FROM {name}_gap)"""


def _totals(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT line_id, year_month,
      coalesce(sum(CASE WHEN ok THEN km END), 0.0) AS total_distance_km,
      coalesce(sum(CASE WHEN ok THEN gap_s / 3600.0 END), 0.0) AS total_time_hours,
      count(*) FILTER (WHERE ok) AS valid_segments,
      count(*) FILTER (WHERE late OR NOT ok) AS skipped_segments
    FROM {source} GROUP BY line_id, year_month)"""


def _graded(name: str, rows: str, join: str) -> str:
    return f"""
{name} AS (SELECT {rows},
      coalesce(total_distance_km, 0.0) AS total_distance_km,
      coalesce(total_time_hours, 0.0) AS total_time_hours,
      CASE WHEN valid_segments > 0 THEN total_distance_km / total_time_hours ELSE 0.0 END AS average_speed_kmh,
      coalesce(valid_segments, 0) AS valid_segments,
      coalesce(skipped_segments, 0) AS skipped_segments,
      CASE WHEN valid_segments > 0 THEN 'OK' ELSE 'NO_DATA' END AS status
    FROM {join})"""


_NAMES = "line_id, short_name, description, year_month"


def _report(name: str, totals: str, months: str) -> str:
    return _graded(
        name, _NAMES, f"routes CROSS JOIN ({months}) m LEFT JOIN {totals} USING (line_id, year_month)"
    )


def _range(first: str, last: str) -> str:
    return (
        "SELECT strftime(g, '%Y-%m') AS year_month FROM generate_series("
        f"TIMESTAMP '{first}-01', TIMESTAMP '{last}-01', INTERVAL 1 MONTH) t(g)"
    )


_NORMAL = _DATAGRAMS + "," + _segments("seg", "valid")
_TOTALS = _NORMAL + "," + _totals("tot", "seg")
_REPORT = _TOTALS + "," + _report("rep", "tot", "SELECT DISTINCT year_month FROM valid")
_OTHER_MONTHS = "SELECT DISTINCT year_month FROM valid WHERE line_id <> -1"
_SORTED = (
    _month_segments("sseg", "ts, seq") + "," + _totals("stot", "sseg") + "," + _report("srep", "stot", _OTHER_MONTHS)
)
_ARRIVAL = (
    _month_segments("aseg", "seq") + "," + _totals("atot", "aseg") + "," + _report("arep", "atot", _OTHER_MONTHS)
)

_SPEED_COLUMNS = (
    f"{_NAMES}, round(total_distance_km, 6) AS total_distance_km, round(total_time_hours, 6) AS total_time_hours,"
    " round(average_speed_kmh, 6) AS average_speed_kmh, valid_segments, skipped_segments, status"
)

_STATES = (
    _DATAGRAMS
    + f""",
c AS (SELECT *, event_type NOT IN (0, 1, 2) AS exceptional FROM d WHERE bus_id <> 0 AND ts IS NOT NULL),
st AS (SELECT *, CASE WHEN exceptional THEN 'CRITICO' WHEN odometer = last_value(
          CASE WHEN NOT exceptional THEN odometer END IGNORE NULLS)
          OVER (PARTITION BY bus_id ORDER BY seq {_BEFORE}) THEN 'PARADO' ELSE 'EN_RUTA' END AS operational_state
       FROM c),
upd AS (SELECT st.*, raw_lat / 1e7 AS lat, raw_lon / 1e7 AS lon, coalesce(z.zone_id, 0) AS zone_id,
          strftime(ts, '%Y-%m-%dT%H:%M') || CASE WHEN second(ts) = 0 THEN '' ELSE strftime(ts, ':%S') END AS ts_text
        FROM st LEFT JOIN zones z USING (line_id)),
alerts AS (SELECT seq, bus_id, line_id, zone_id, event_type, 'ALTA' AS priority, ts,
             'Excepcional eventType=' || CAST(event_type AS VARCHAR) AS description FROM upd WHERE exceptional),
subs AS (SELECT n_name AS subscriber, CAST(n_nationkey % 5 AS INT) AS zone_id FROM nation
         UNION ALL SELECT n_name, CAST((n_nationkey + 1) % 5 AS INT) FROM nation WHERE n_nationkey % 2 = 0),
last_upd AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY bus_id ORDER BY seq DESC) = 1)"""
)
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
_UPDATE = f"seq, bus_id, round(lat, 7) AS lat, round(lon, 7) AS lon, line_id, {_TS}, ts_text, zone_id, operational_state"
_ALERT = f"seq, bus_id, line_id, zone_id, event_type, priority, {_TS}, description"
_LATEST = f"bus_id, line_id, round(lat, 7) AS lat, round(lon, 7) AS lon, {_TS}, zone_id, operational_state"
_BOARD = """SELECT count(*) AS buses,
      count(*) FILTER (WHERE operational_state = 'EN_RUTA') AS en_route,
      count(*) FILTER (WHERE operational_state = 'PARADO') AS stopped,
      CAST(0 AS BIGINT) AS no_signal,
      count(*) FILTER (WHERE operational_state = 'CRITICO') AS critical,
      (SELECT count(*) FROM alerts) AS alerts FROM last_upd"""
_REACHES = "EXISTS (SELECT 1 FROM subs s WHERE s.subscriber = p.subscriber AND s.zone_id IN (0, x.zone_id))"
_PEOPLE = "(SELECT DISTINCT subscriber FROM subs) p"

_DELIVERIES = """SELECT zone_id AS delivery_key, 'update' AS kind, seq FROM upd
      UNION ALL SELECT CASE WHEN seq % 2 = 0 THEN zone_id ELSE -1 END, 'alert', seq FROM alerts"""
_LISTENERS = """listeners AS (SELECT DISTINCT s_name AS subscriber, CAST(unnest(
        CASE WHEN s_suppkey % 3 <> 0 THEN [s_nationkey % 5]
             WHEN s_suppkey % 2 = 0 THEN [s_nationkey % 5, (s_nationkey % 5 + 1) % 5] ELSE [] END) AS INT) AS zone_id
      FROM supplier)"""

_CSV_KEPT = "seq % 97 <> 0"
_RUN = """SELECT count(*) AS processed_rows,
      count(*) - count(*) FILTER (WHERE reason IS NOT NULL) - (SELECT count(*) FROM seg WHERE late) AS valid_rows,
      count(*) FILTER (WHERE reason IS NOT NULL) + (SELECT count(*) FROM seg WHERE late) AS skipped_rows
    FROM tagged"""
_SPEED_LINE = (
    "CAST(line_id AS VARCHAR) || ',\"' || short_name || '\",\"' || description || '\",' || year_month || ','"
    " || printf('%.6f', total_distance_km) || ',' || printf('%.9f', total_time_hours) || ','"
    " || printf('%.6f', average_speed_kmh) || ',' || CAST(valid_segments AS VARCHAR) || ','"
    " || CAST(skipped_segments AS VARCHAR) || ',' || status"
)
_JSON = (
    "'{\"lineId\":' || CAST(line_id AS VARCHAR) || ',\"shortName\":\"' || short_name || '\",\"description\":\"'"
    " || description || '\",\"yearMonth\":\"' || year_month || '\",\"averageSpeedKmH\":'"
    " || CAST(round(average_speed_kmh, 6) AS VARCHAR) || ',\"totalDistanceKm\":'"
    " || CAST(round(total_distance_km, 6) AS VARCHAR) || ',\"totalTimeHours\":'"
    " || CAST(round(total_time_hours, 6) AS VARCHAR) || ',\"validSegments\":' || CAST(valid_segments AS VARCHAR)"
    " || ',\"skippedSegments\":' || CAST(skipped_segments AS VARCHAR) || ',\"status\":\"' || status || '\"}'"
)


def _with(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


def oracle_sql() -> dict[str, str]:
    flagship = _with(_REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep ORDER BY year_month, line_id")
    ranged = _with(
        _TOTALS + "," + _report("r", "tot", _range("2018-04", "2018-08")),
        f"SELECT {_SPEED_COLUMNS} FROM r ORDER BY year_month, line_id",
    )
    month = _with(
        _TOTALS + "," + _report("r", "tot", _range("2018-06", "2018-06")),
        f"SELECT {_SPEED_COLUMNS} FROM r ORDER BY line_id",
    )
    updates = _with(_STATES, f"SELECT {_UPDATE} FROM upd")
    alerts = _with(_STATES, f"SELECT {_ALERT} FROM alerts")
    run = _with(_NORMAL, _RUN)
    loaded = _with(
        _DATAGRAMS
        + f", whole AS (SELECT * FROM valid WHERE {_CSV_KEPT}),"
        + _segments("seg", "whole")
        + ","
        + _totals("tot", "seg")
        + ","
        + _report("rep", "tot", "SELECT DISTINCT year_month FROM whole"),
        f"SELECT {_SPEED_COLUMNS} FROM rep ORDER BY year_month, line_id",
    )
    silences = _with(
        _STATES
        + """,
        g AS (SELECT bus_id, seq, lag(ts) OVER (PARTITION BY bus_id ORDER BY seq) AS last_ts, ts FROM c)""",
        f"""SELECT bus_id, seq, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, {_TS},
          date_diff('second', last_ts, ts) AS silent_s FROM g WHERE date_diff('second', last_ts, ts) > 60""",
    )
    throttled = _with(
        _STATES,
        """SELECT bus_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00'),
            '%Y-%m-%d %H:%M:%S') AS window_start,
          count(*) AS alerts, min(seq) AS first_seq, arg_min(description, seq) AS description
        FROM alerts GROUP BY 1, 2""",
    )
    young = f""",
        aged AS (SELECT *, max(ts) OVER (PARTITION BY bus_id ORDER BY seq {_BEFORE}) AS newest FROM alerts),
        young AS (SELECT * FROM aged WHERE NOT coalesce(ts < newest - INTERVAL 1 DAY, false))"""
    throttled_within = _with(
        _STATES + young,
        """SELECT bus_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01 00:00:00'),
            '%Y-%m-%d %H:%M:%S') AS window_start,
          count(*) AS alerts, min(seq) AS first_seq, arg_min(description, seq) AS description
        FROM young GROUP BY 1, 2""",
    )
    sql = {
        "route_month_speed": flagship,
        "partial_merge_by_bus_shard": flagship,
        "route_month_speed_sorted": _with(
            _DATAGRAMS + "," + _SORTED, f"SELECT {_SPEED_COLUMNS} FROM srep ORDER BY year_month, line_id"
        ),
        "route_month_speed_arrival": _with(
            _DATAGRAMS + "," + _ARRIVAL, f"SELECT {_SPEED_COLUMNS} FROM arep ORDER BY year_month, line_id"
        ),
        "month_range_report": ranged,
        "lake_range_report": ranged,
        "single_month_report": month,
        "lake_month_report": month,
        "named_route_report": _with(
            _DATAGRAMS
            + ","
            + _segments("seg", "plausible")
            + ","
            + _totals("tot", "seg")
            + ","
            + _graded(
                "r",
                "line_id, coalesce(short_name, 'UNKNOWN') AS short_name,"
                " coalesce(description, 'NA') AS description, year_month",
                "tot LEFT JOIN routes USING (line_id)",
            ),
            f"SELECT {_SPEED_COLUMNS} FROM r ORDER BY year_month, line_id",
        ),
        "observed_months": _with(_DATAGRAMS, "SELECT DISTINCT year_month FROM valid"),
        "run_metrics": run,
        "partition_metrics": _with(
            _DATAGRAMS + "," + _month_segments("aseg", "seq"),
            """SELECT line_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
              count(*) AS datagrams_read, count(*) FILTER (WHERE ok) AS valid_segments,
              count(*) FILTER (WHERE NOT ok) AS outliers_dropped, CAST(0 AS BIGINT) AS minus_one_filtered
            FROM aseg GROUP BY 1, 2, 3""",
        ),
        "haversine_segments": _with(
            _NORMAL,
            f"""SELECT seq, {_TRIP}, year_month, round(km, 6) AS km, round(gap_s / 1.0, 6) AS seconds,
              round(km / (gap_s / 3600.0), 6) AS kmh, ok AS segment_ok FROM seg WHERE ok IS NOT NULL""",
        ),
        # Validation
        "valid_datagrams": _with(
            _DATAGRAMS,
            f"SELECT seq, {_TRIP}, round(lat, 7) AS lat, round(lon, 7) AS lon, {_TS} FROM valid",
        ),
        "inactive_line_datagrams": _with(
            _DATAGRAMS,
            "SELECT seq, bus_id, line_id FROM d WHERE line_id NOT IN (SELECT line_id FROM routes)",
        ),
        "rejects_by_reason": _with(
            _DATAGRAMS, "SELECT reason, count(*) AS rejects FROM tagged WHERE reason IS NOT NULL GROUP BY reason"
        ),
        "reject_sample": _with(
            _DATAGRAMS,
            "SELECT seq, bus_id, line_id, reason FROM tagged WHERE reason IS NOT NULL ORDER BY seq LIMIT 20",
        ),
        "accept_reject_split": _with(
            _DATAGRAMS,
            """SELECT line_id, count(*) FILTER (WHERE reason IS NULL) AS accepted,
              count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM tagged GROUP BY line_id""",
        ),
        "input_cap": _with(_DATAGRAMS, "SELECT seq, bus_id, line_id FROM d ORDER BY seq LIMIT 500"),
        "empty_record_guard": _with(
            _DATAGRAMS, "SELECT bus_id <> 0 AND ts IS NOT NULL AS kept, count(*) AS n FROM d GROUP BY 1"
        ),
        # Text
        "csv_parse_roundtrip": _with(
            _DATAGRAMS,
            f"""SELECT seq, event_type, register_date, stop_id, odometer, raw_lat, raw_lon, task_id, line_id,
              trip_id, unknown1, {_TS}, bus_id FROM d WHERE {_CSV_KEPT}""",
        ),
        "csv_parse_errors": _with(
            _DATAGRAMS,
            f"""SELECT CASE WHEN {_CSV_KEPT} THEN 'NONE' ELSE 'FieldCount' END AS parse_error, count(*) AS n
            FROM d GROUP BY 1""",
        ),
        "csv_file_scan": loaded,
        "archive_scan": loaded,
        "lake_two_loads": loaded,
        "lake_bulk_then_stream": loaded,
        "live_chain": _with(
            _DATAGRAMS
            + f""",
acc AS (SELECT *, event_type NOT IN (0, 1, 2) AS exceptional FROM valid WHERE {_CSV_KEPT}),
told AS (SELECT *, CASE WHEN exceptional THEN 'CRITICO' WHEN odometer = last_value(
          CASE WHEN NOT exceptional THEN odometer END IGNORE NULLS)
          OVER (PARTITION BY bus_id ORDER BY seq {_BEFORE}) THEN 'PARADO' ELSE 'EN_RUTA' END AS operational_state FROM acc)""",
            "SELECT bus_id, line_id, operational_state, count(*) AS n FROM told GROUP BY ALL",
        ),
        "range_result_file": ranged,
        "route_catalogue_scan": _with(_DATAGRAMS, "SELECT * FROM routes"),
        "zone_map_scan": _with(_DATAGRAMS, "SELECT line_id, zone_id FROM zones"),
        "month_inference": _with(
            _DATAGRAMS,
            "SELECT seq, CASE WHEN seq % 5 < 3 THEN strftime(ts, '%Y-%m') ELSE '2018-01' END AS year_month FROM d",
        ),
        "iso_timestamps": _with(
            _DATAGRAMS,
            """SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M') || CASE WHEN second(ts) = 0 THEN ''
              ELSE strftime(ts, ':%S') END AS ts_text FROM d""",
        ),
        "speed_band": """SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 21 + 0.5 >= 15
            THEN 'good' WHEN event_id % 21 + 0.5 >= 10 THEN 'med' ELSE 'bad' END AS band FROM events""",
        # Report queries
        "report_point": _with(
            _REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep WHERE line_id = 101 AND year_month = '2018-06'"
        ),
        "report_month": _with(_REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep WHERE year_month = '2018-06'"),
        "report_range": _with(
            _REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep WHERE year_month BETWEEN '2018-06' AND '2018-12'"
        ),
        "report_first_version": _with(_REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep"),
        "report_upsert": _with(
            _REPORT + "," + _SORTED,
            f"""SELECT {_SPEED_COLUMNS} FROM srep WHERE year_month = '2018-06'
            UNION ALL SELECT {_SPEED_COLUMNS} FROM rep WHERE year_month <> '2018-06'""",
        ),
        "report_table": _with(
            _REPORT,
            """SELECT line_id, year_month, round(average_speed_kmh, 6) AS average_speed_kmh,
              CASE WHEN average_speed_kmh >= 15 THEN 'good' WHEN average_speed_kmh >= 10 THEN 'med' ELSE 'bad' END
              AS band FROM rep WHERE year_month BETWEEN '2018-04' AND '2018-08'""",
        ),
        "report_delta": _with(
            _REPORT
            + """,
            dl AS (SELECT line_id, year_month, average_speed_kmh,
              lag(average_speed_kmh) OVER (PARTITION BY line_id ORDER BY year_month) AS previous_kmh FROM rep)""",
            """SELECT line_id, year_month, round(average_speed_kmh, 6) AS average_speed_kmh,
              round(previous_kmh, 6) AS previous_kmh, round(average_speed_kmh - previous_kmh, 6) AS delta_kmh
            FROM dl WHERE previous_kmh IS NOT NULL ORDER BY abs(average_speed_kmh - previous_kmh) DESC, line_id, year_month""",
        ),
        "report_of_routes": _with(
            _REPORT,
            f"""SELECT {_SPEED_COLUMNS} FROM rep WHERE line_id IN (100, 102, 104, -1, 110)
            ORDER BY rep.average_speed_kmh DESC, line_id, year_month""",
        ),
        "report_preview": _with(_REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep ORDER BY year_month, line_id LIMIT 30"),
        "report_store_order": _with(_REPORT, f"SELECT {_SPEED_COLUMNS} FROM rep ORDER BY line_id, year_month"),
        "run_summary": _with(_REPORT, "SELECT status, count(*) AS reports FROM rep GROUP BY status"),
        "report_json": _with(_REPORT, f"SELECT line_id, year_month, {_JSON} AS json FROM rep"),
        "report_json_array": _with(
            _REPORT, f"SELECT '[' || string_agg({_JSON}, ',' ORDER BY year_month, line_id) || ']' AS json FROM rep"
        ),
        "report_json_chunks": _with(
            _REPORT,
            f"""SELECT CAST(0 AS INT) AS part, CAST(0 AS BIGINT) AS chunk, '[' AS json UNION ALL SELECT 2, 0, ']' UNION ALL
            SELECT 1, n // 40, CASE WHEN n >= 40 THEN ',' ELSE '' END || string_agg(json, ',' ORDER BY n)
            FROM (SELECT row_number() OVER (ORDER BY year_month, line_id) - 1 AS n, {_JSON} AS json FROM rep)
            GROUP BY n // 40, n >= 40""",
        ),
        "speed_csv_lines": _with(
            _REPORT,
            f"""SELECT value FROM (SELECT 0 AS part, '' AS ym, 0 AS l,
              'lineId,shortName,description,yearMonth,totalDistanceKm,totalTimeHours,averageSpeedKmH,validSegments,skippedSegments,status' AS value
              UNION ALL SELECT 1, year_month, line_id, {_SPEED_LINE} FROM rep) ORDER BY part, ym, l""",
        ),
        "speed_csv_roundtrip": _with(
            _REPORT,
            f"""SELECT {_NAMES}, round(total_distance_km, 6) AS total_distance_km,
              round(round(total_time_hours, 9), 6) AS total_time_hours,
              round(average_speed_kmh, 6) AS average_speed_kmh, valid_segments, skipped_segments, status
            FROM rep""",
        ),
        "metrics_csv": _with(
            _NORMAL + f", run AS ({_RUN})",
            """SELECT 'version,dataset,processedRows,validRows,skippedRows,executionTimeMs,throughputRowsPerSecond,memoryUsedMb,resultRows' AS value
            UNION ALL SELECT '"spark","events",' || CAST(processed_rows AS VARCHAR) || ',' || CAST(valid_rows AS VARCHAR)
              || ',' || CAST(skipped_rows AS VARCHAR) || ',2000,' || printf('%.2f', processed_rows / 2.0)
              || ',0.00,75' FROM run""",
        ),
        "result_reconcile": _with(
            _REPORT + "," + _ARRIVAL,
            """SELECT * FROM (SELECT line_id, year_month, round(a.average_speed_kmh, 6) AS actual_kmh,
              a.valid_segments AS actual_segments, a.skipped_segments AS actual_skipped, a.status AS actual_status,
              round(e.average_speed_kmh, 6) AS expected_kmh, e.valid_segments AS expected_segments, e.skipped_segments AS expected_skipped,
              e.status AS expected_status,
              CASE WHEN a.status IS NULL THEN 'MISSING' WHEN e.status IS NULL THEN 'UNEXPECTED'
                WHEN abs(a.average_speed_kmh - e.average_speed_kmh) > 1e-4 THEN 'SPEED'
                WHEN a.valid_segments <> e.valid_segments OR a.skipped_segments <> e.skipped_segments THEN 'SEGMENTS'
                WHEN a.status <> e.status THEN 'STATUS' END AS difference
              FROM arep a FULL OUTER JOIN rep e USING (line_id, year_month)) WHERE difference IS NOT NULL""",
        ),
        "union_parts": _with(
            _TOTALS + "," + _report("r", "tot", _range("2018-05", "2018-07")), f"SELECT {_SPEED_COLUMNS} FROM r"
        ),
        # Real-time rules
        "event_category": _with(
            _DATAGRAMS,
            """SELECT seq, event_type, CASE WHEN event_type IN (0, 1, 2) THEN 'ROUTINE' ELSE 'EXCEPTIONAL' END
              AS category FROM d""",
        ),
        "operational_state": _with(_STATES, "SELECT seq, bus_id, operational_state FROM st"),
        "bus_updates": updates,
        "stream_updates_replay": updates,
        "critical_alerts": alerts,
        "stream_alerts_replay": alerts,
        "stream_publish_replay": _with(
            _STATES,
            """SELECT bus_id, count(*) AS n, 'updates' AS kind FROM upd GROUP BY bus_id
            UNION ALL SELECT bus_id, count(*), 'alerts' FROM alerts GROUP BY bus_id""",
        ),
        "alert_history": _with(_STATES, f"SELECT {_ALERT} FROM alerts ORDER BY seq DESC LIMIT 50"),
        "signal_gaps": silences,
        "signal_lost_asof": _with(
            _STATES,
            """SELECT bus_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_ts,
              date_diff('second', ts, TIMESTAMP '2018-06-04 07:20:00') AS silent_s,
              date_diff('second', ts, TIMESTAMP '2018-06-04 07:20:00') > 60 AS signal_lost FROM last_upd""",
        ),
        "stream_signal_loss_replay": _with(
            _STATES
            + """,
            g AS (SELECT bus_id, ts, lag(ts) OVER (PARTITION BY bus_id ORDER BY seq) AS last_ts FROM c),
            lost AS (SELECT bus_id, last_ts FROM g WHERE date_diff('second', last_ts, ts) > 60)""",
            """SELECT bus_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, 'SIN_SENAL' AS operational_state
            FROM lost""",
        ),
        "stream_segments_replay": flagship,
        "carried_segments": flagship,
        "carried_updates": updates,
        "carried_silences": silences,
        "carried_unrepeated": _with(
            _STATES
            + f""",
            t AS (SELECT *, max(ts) OVER (PARTITION BY bus_id ORDER BY seq {_BEFORE}) AS newest FROM c),
            j AS (SELECT *, coalesce(ts < newest - INTERVAL 1 HOUR, false) AS old FROM t)""",
            """SELECT min(seq) AS seq, bus_id, 'kept' AS what FROM j WHERE NOT old GROUP BY bus_id, ts, trip_id
            UNION ALL SELECT seq, bus_id, 'aside' FROM j WHERE old""",
        ),
        "latest_bus_state": _with(_STATES, f"SELECT {_LATEST} FROM last_upd"),
        "bus_detail": _with(_STATES, f"SELECT {_LATEST} FROM last_upd WHERE bus_id = 3"),
        "fleet_status": _with(
            _STATES, "SELECT operational_state, count(*) AS buses FROM last_upd GROUP BY operational_state"
        ),
        "status_board": _with(_STATES, _BOARD),
        "stream_status_board": _with(_STATES, _BOARD),
        "live_map_filter": _with(
            _STATES,
            f"""SELECT {_UPDATE} FROM upd WHERE line_id IN (100, 101, 102, 103) AND zone_id = 1
              AND upd.ts BETWEEN TIMESTAMP '2018-05-31 23:00:00' AND TIMESTAMP '2018-06-01 12:00:00'""",
        ),
        "line_zone": _with(
            _DATAGRAMS,
            """SELECT seq, line_id, coalesce(zone_id, 0) AS zone_id FROM d LEFT JOIN zones USING (line_id)""",
        ),
        "user_zone": """SELECT s_name AS user_id, CAST(s_nationkey % 5 AS INT) AS zone_id FROM supplier
            UNION ALL SELECT c_name, CAST(0 AS INT) FROM customer""",
        "subscription_fanout": _with(
            _STATES,
            f"SELECT subscriber, seq, bus_id, zone_id, operational_state FROM upd x, {_PEOPLE} WHERE {_REACHES}",
        ),
        "stream_fanout_replay": _with(
            _STATES, f"SELECT subscriber, seq, bus_id, zone_id FROM upd x, {_PEOPLE} WHERE {_REACHES}"
        ),
        "alert_fanout": _with(
            _STATES
            + """,
            mixed AS (SELECT seq, zone_id, CASE WHEN seq % 2 = 0 THEN 'BAJA' ELSE priority END AS priority
              FROM alerts)""",
            f"""SELECT subscriber, seq, zone_id, priority FROM mixed x, {_PEOPLE}
            WHERE priority = 'ALTA' OR {_REACHES}""",
        ),
        "delivery_counts": _with(
            _STATES,
            f"""SELECT subscriber, (SELECT count(*) FROM upd x WHERE {_REACHES}) AS updates,
              (SELECT count(*) FROM alerts) AS alerts FROM {_PEOPLE}""",
        ),
        "zone_deliveries": _with(_STATES, _DELIVERIES),
        "supplier_inbox_counts": _with(
            _STATES + f", del AS ({_DELIVERIES}), {_LISTENERS}",
            """SELECT subscriber, count(DISTINCT seq) FILTER (kind = 'update') AS updates,
              count(DISTINCT seq) FILTER (kind = 'alert') AS alerts
            FROM listeners LEFT JOIN del ON zone_id = 0 OR delivery_key = zone_id OR delivery_key = -1 GROUP BY subscriber""",
        ),
        "supplier_inbox": _with(
            _STATES + f", del AS ({_DELIVERIES}), {_LISTENERS}",
            """SELECT DISTINCT kind, seq FROM listeners JOIN del ON zone_id = 0 OR delivery_key = zone_id OR delivery_key = -1
            WHERE subscriber = 'Supplier#000000006'""",
        ),
        "accept_reject_rows": _with(_DATAGRAMS, "SELECT seq, line_id, coalesce(reason, 'accepted') AS reason FROM tagged"),
        "stream_ingest_rows": _with(_DATAGRAMS, "SELECT seq, line_id, coalesce(reason, 'accepted') AS reason FROM tagged"),
        "bus_shard_rows": _with(
            _DATAGRAMS,
            f"""SELECT 'chunk-' || lpad(CAST(bus_id % 4 AS VARCHAR), 2, '0') AS shard, unknown1, line_id, trip_id, bus_id,
              raw_lat, raw_lon, {_TS} FROM d WHERE {_CSV_KEPT} AND bus_id > 0""",
        ),
        "stream_publish_rows": _with(
            _STATES,
            """SELECT seq, bus_id, zone_id, operational_state, CAST(NULL AS INT) AS event_type FROM upd
            UNION ALL SELECT seq, bus_id, zone_id, 'ALERT', event_type FROM alerts""",
        ),
        "measured_run": _with(
            _NORMAL + f", run AS ({_RUN})" + ","
            + _totals("tot", "seg") + "," + _report("rep", "tot", "SELECT DISTINCT year_month FROM valid"),
            "SELECT processed_rows, valid_rows, skipped_rows, (SELECT count(*) FROM rep) AS result_rows, true AS measured FROM run",
        ),
        "update_speed_enriched": _with(
            _STATES + "," + _segments("seg", "valid") + "," + _totals("tot", "seg"),
            """SELECT seq, bus_id, upd.line_id, strftime(ts, '%Y-%m') AS year_month,
              round(CASE WHEN valid_segments > 0 THEN total_distance_km / total_time_hours END, 6) AS line_speed_kmh
            FROM upd LEFT JOIN tot ON tot.line_id = upd.line_id AND tot.year_month = strftime(ts, '%Y-%m')""",
        ),
        "stream_enriched_replay": _with(
            _STATES + "," + _segments("seg", "valid") + "," + _totals("tot", "seg"),
            """SELECT seq, upd.line_id, strftime(ts, '%Y-%m') AS year_month,
              round(CASE WHEN valid_segments > 0 THEN total_distance_km / total_time_hours END, 6) AS line_speed_kmh
            FROM upd LEFT JOIN tot ON tot.line_id = upd.line_id AND tot.year_month = strftime(ts, '%Y-%m')""",
        ),
        "alert_last_position": _with(
            _STATES
            + """,
            known AS (SELECT bus_id, seq, lat, lon FROM upd)""",
            """SELECT a.seq, a.bus_id, a.line_id, round(coalesce(k.lat, 3.42), 7) AS lat,
              round(coalesce(k.lon, -76.52), 7) AS lon
            FROM alerts a ASOF LEFT JOIN known k ON a.bus_id = k.bus_id AND a.seq >= k.seq""",
        ),
        "alert_throttle": throttled,
        "stream_alert_throttle": throttled,
        "carried_throttle": throttled_within,
        "stream_deduplicated": _with(
            _STATES, f"SELECT DISTINCT bus_id, trip_id, {_TS} FROM c"
        ),
        # Lake
        "lake_roundtrip": _with(
            _DATAGRAMS,
            f"""SELECT seq, {_TRIP}, CAST(year(ts) AS INT) AS year, strftime(ts, '%m') AS month, {_TS} FROM valid""",
        ),
        "lake_partitions": _with(
            _DATAGRAMS,
            "SELECT DISTINCT line_id, CAST(year(ts) AS INT) AS year, strftime(ts, '%m') AS month FROM valid",
        ),
        "lake_partition_scan": _with(
            _DATAGRAMS,
            f"SELECT seq, bus_id, trip_id, {_TS} FROM valid WHERE line_id = -1 AND year_month = '2018-06'",
        ),
        "bus_shards": _with(
            _DATAGRAMS,
            f"""SELECT 'chunk-' || lpad(CAST(bus_id % 4 AS VARCHAR), 2, '0') AS shard, count(*) AS n,
              count(*) AS distinct_lines FROM d WHERE {_CSV_KEPT} AND bus_id > 0 GROUP BY 1""",
        ),
        "stream_ingest_replay": _with(
            _DATAGRAMS,
            """SELECT CASE WHEN reason IS NULL THEN 'line ' || CAST(line_id AS VARCHAR) ELSE 'reject ' || reason END
              AS what, count(*) AS n FROM tagged GROUP BY 1""",
        ),
    }
    counters = _with(
        _DATAGRAMS,
        """SELECT count(*) FILTER (WHERE bus_id <> 0) AS consumed, count(*) FILTER (WHERE bus_id <> 0) AS published,
          count(*) FILTER (WHERE bus_id = 0) AS skipped FROM d""",
    )
    sql["stream_counters"] = sql["stream_counters_batch"] = counters
    return sql
