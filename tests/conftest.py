from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetspeed.schema import DATAGRAM_SCHEMA, ROUTE_SCHEMA  # noqa: E402
from fleetspeed.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        cores="4",
        memory="4g",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    yield session
    session.stop()


def datagram(seq, line_id, trip_id, ts, raw_lat, raw_lon, bus_id, event_type=0, odometer=70):
    """One datagram row; fields that no rule looks at are constant."""
    stamp = datetime.fromisoformat(ts) if isinstance(ts, str) else ts
    return (
        seq, event_type, "14-MAY-19", 604118, odometer, raw_lat, raw_lon, 391,
        line_id, trip_id, 7300125588, stamp, bus_id,
    )


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, DATAGRAM_SCHEMA)


@pytest.fixture(scope="session")
def routes(spark):
    rows = [(207, "E7", "East loop"), (219, "N19", "North hill"), (233, "S33", "South gate")]
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


# One trip that moves east and gets a report from the past, an unknown line, and a lone report.
SIX_ROWS = [
    datagram(1, 207, 31, "2019-05-14 06:30:10", 34512000, -765310000, 42),
    datagram(2, 207, 31, "2019-05-14 06:31:05", 34512000, -765303500, 42),
    datagram(3, 207, 31, "2019-05-14 06:32:20", 34512400, -765297000, 42),
    datagram(4, 207, 31, "2019-05-14 06:29:40", 34513000, -765290000, 42),
    datagram(5, 888, 9, "2019-05-14 06:33:00", 34512400, -765297000, 42),
    datagram(6, 219, 64, "2019-05-14 07:00:00", 34498000, -765120000, 57),
]
