"""Keyed state: last odometer and last report of a bus, last accepted report of a trip.

Each processor gets the rows of one key of one micro-batch as Arrow batches.  The landing
sources bound a micro-batch by size, which bounds those rows too.  A shuffle does not keep the order of arrival, so
the few columns that a state needs are put in that order here; the rows themselves are held once, as they came, and
passed on batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetspeed.schema import (
    CRITICAL,
    EN_ROUTE,
    NO_SIGNAL,
    ROUTINE_EVENT_TYPES,
    STOPPED,
)

SECOND_US = 1_000_000
# A trip without a report for a day is over, and its state goes.
TRIP_TTL_MS = 24 * 3600 * 1000


def _arrivals(frames: list[pd.DataFrame]) -> np.ndarray:
    """Places of all rows in order of arrival."""
    return np.argsort(np.concatenate([f["seq"].to_numpy() for f in frames]), kind="stable")


def _column(frames: list[pd.DataFrame], name: str, order: np.ndarray) -> np.ndarray:
    return np.concatenate([f[name].to_numpy() for f in frames])[order]


def _back(found: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values found in order of arrival, in the order of the rows."""
    placed = np.empty_like(found)
    placed[order] = found
    return placed


def _passed_on(frames: list[pd.DataFrame], columns: Callable[[slice], dict]) -> Iterator[pd.DataFrame]:
    """Each batch with more columns, given by its place among all rows; a batch goes when it is passed on."""
    at = 0
    frames.reverse()
    while frames:
        frame = frames.pop()
        yield frame.assign(**columns(slice(at, at + len(frame))))
        at += len(frame)


class OperationalState(StatefulProcessor):
    """Adds ``operational_state``; remembers the last routine odometer of the bus."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._odometer = handle.getValueState(
            "routine_odometer", T.StructType([T.StructField("value", T.LongType())])
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        order = _arrivals(frames)
        routine = np.concatenate([f["event_type"].isin(ROUTINE_EVENT_TYPES).to_numpy() for f in frames])[order]
        readings = _column(frames, "odometer", order)[routine]
        label = np.zeros(len(order), dtype=np.int8)
        if len(readings):
            same = np.empty(len(readings), dtype=bool)
            same[1:] = readings[1:] == readings[:-1]
            same[0] = self._odometer.exists() and self._odometer.get()[0] == readings[0]
            label[routine] = np.where(same, 1, 2)
            if pd.isna(readings[-1]):
                self._odometer.clear()
            else:
                self._odometer.update((int(readings[-1]),))
        label, names = _back(label, order), np.array([CRITICAL, STOPPED, EN_ROUTE], dtype=object)
        yield from _passed_on(frames, lambda part: {"operational_state": names[label[part]]})

    def close(self) -> None:
        pass


class SignalLoss(StatefulProcessor):
    """Emits one row per silence of a bus longer than the limit.

    A silence shows when the next report arrives, by the times of the reports.  On a live stream a
    timer per bus tells it before that, when no report has arrived for as long as the limit.  It
    is reported once, whichever comes first.  Buses have no clock in common, so a bus that is late
    or ahead changes nothing for the others.
    """

    def __init__(self, limit_s: int, timers: bool):
        self._limit_s, self._timers = limit_s, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState(
            "last_report",
            T.StructType(
                [T.StructField("ts_us", T.LongType()), T.StructField("reported", T.BooleanType())]
            ),
        )

    def _rows(self, bus_id: int, last_us) -> pd.DataFrame:
        last_us = np.atleast_1d(np.asarray(last_us, dtype="int64"))
        return pd.DataFrame(
            {
                "bus_id": np.full(len(last_us), bus_id, dtype="int32"),
                "last_us": last_us,
                "operational_state": NO_SIGNAL,
            }
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        needed = [f[["seq", "ts_us"]] for f in rows]
        times = _column(needed, "ts_us", _arrivals(needed)).astype("int64", copy=False)
        reported = False
        if self._last.exists():
            last_us, reported = self._last.get()
            times = np.concatenate([[last_us], times])
        silent = (times[1:] - times[:-1]) // SECOND_US > self._limit_s
        if reported and len(silent):
            silent[0] = False
        if silent.any():
            yield self._rows(key[0], times[:-1][silent])
        self._last.update((int(times[-1]), False))
        if self._timers:
            # Only the newest report may have a timer.
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            now_ms = timerValues.getCurrentProcessingTimeInMs()
            self._handle.registerTimer(now_ms + (self._limit_s + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_us, reported = self._last.get()
        self._last.update((last_us, True))
        if not reported:
            yield self._rows(key[0], last_us)

    def close(self) -> None:
        pass


class TripSegments(StatefulProcessor):
    """Adds the earlier end of the segment a report closes, and whether the report is late.

    Late means not newer than the last accepted report of the trip; a late report leaves the
    state untouched, so lateness is judged per trip and not by a watermark.  On a live stream the
    state of a trip expires.
    """

    def __init__(self, expires: bool):
        self._expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState(
            "accepted",
            T.StructType(
                [
                    T.StructField("ts_us", T.LongType()),
                    T.StructField("lat", T.DoubleType()),
                    T.StructField("lon", T.DoubleType()),
                ]
            ),
            ttlDurationMs=TRIP_TTL_MS if self._expires else None,
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        order = _arrivals(frames)
        times, lat, lon = (_column(frames, n, order) for n in ("ts_us", "lat", "lon"))
        times = times.astype("int64", copy=False)
        known = self._last.get() if self._last.exists() else None
        floor = known[0] if known else np.iinfo("int64").min
        newest = np.maximum.accumulate(np.concatenate([[floor], times[:-1]]))
        late = times <= newest
        accepted = np.flatnonzero(~late)
        # The place of the earlier end of each accepted report; the first one of them has its own.
        has = np.zeros(len(order), dtype=bool)
        has[accepted[0 if known else 1 :]] = True
        before = {}
        for n, (name, values) in enumerate((("ts_us", times), ("lat", lat), ("lon", lon))):
            earlier = np.full(len(order), 0 if name == "ts_us" else np.nan, dtype=values.dtype)
            earlier[accepted[1:]] = values[accepted[:-1]]
            if known and len(accepted):
                earlier[accepted[0]] = known[n]
            before[name] = _back(earlier, order)
        if len(accepted):
            end = accepted[-1]
            self._last.update((int(times[end]), float(lat[end]), float(lon[end])))
        late, has = _back(late, order), _back(has, order)
        yield from _passed_on(
            frames,
            lambda part: {
                "late": late[part],
                "prev_ts_us": pd.arrays.IntegerArray(before["ts_us"][part], ~has[part]),
                "prev_lat": before["lat"][part],
                "prev_lon": before["lon"][part],
            },
        )

    def close(self) -> None:
        pass
