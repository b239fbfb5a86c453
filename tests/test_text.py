from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from fleetspeed.functions import geo, text, timekeys
from fleetspeed.sources.datagrams import parse_lines, readable

CANONICAL = "0,14-MAY-19,604118,70,34512345,-765310987,391,2077,31,7300125588,2019-05-14 06:30:10,4217"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def parsed(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, value string")
    return parse_lines(df).orderBy("seq").collect()


def test_canonical_line(spark):
    (row,) = parsed(spark, CANONICAL)
    assert row["parse_error"] is None
    assert (row["line_id"], row["trip_id"], row["bus_id"], row["unknown1"]) == (2077, 31, 4217, 7300125588)
    assert str(row["ts"]) == "2019-05-14 06:30:10"
    assert one(spark, geo.degrees_of(F.lit(row["raw_lat"]))) == pytest.approx(3.4512345)
    assert one(spark, geo.degrees_of(F.lit(row["raw_lon"]))) == pytest.approx(-76.5310987)


def test_scientific_notation(spark):
    (row,) = parsed(spark, CANONICAL.replace("7300125588", "7.300125588E9"))
    assert row["parse_error"] is None and row["unknown1"] == 7300125588


@pytest.mark.parametrize(
    "line, error",
    [
        ("not,enough,fields", "FieldCount"),
        ("", "FieldCount"),
        (CANONICAL + ",1", "FieldCount"),
        (CANONICAL.replace("2019-05-14", "2019-05-xx"), "FieldFormat"),
        (CANONICAL.replace("2019-05-14 06:30:10", "2019-05-14"), "FieldFormat"),
        (CANONICAL.replace(",391,", ",39.1,"), "FieldFormat"),
        (CANONICAL.replace(",4217", ",99999999999"), "FieldFormat"),
        (CANONICAL.replace(",31,", ",,"), "FieldFormat"),
    ],
)
def test_bad_lines(spark, line, error):
    (row,) = parsed(spark, line)
    assert row["parse_error"] == error


def test_blank_padding_and_quotes(spark):
    padded = ", ".join(CANONICAL.split(","))
    quoted = ",".join(f'"{f}"' for f in CANONICAL.split(","))
    for row in parsed(spark, padded, quoted):
        assert row["parse_error"] is None and row["bus_id"] == 4217


@pytest.mark.parametrize(
    "line, fields",
    [
        ("a,b,,", ["a", "b", "", ""]),
        ('"a,b",c', ["a,b", "c"]),
        ('"say ""hi"", you",z', ['say "hi", you', "z"]),
        ('x"y,z"w,v', ["xy,zw", "v"]),
        ('"",b', ["", "b"]),
        ('""""', ['"']),
        ('a,"open,rest', ["a", "open,rest"]),
        ("", [""]),
    ],
)
def test_split_fields(spark, line, fields):
    assert one(spark, text.split_fields(F.lit(line))) == fields


TOKEN = re.compile(r'(?P<quoted>"(?:[^"]|"")*"?)|(?P<comma>,)|(?P<plain>[^",]+)')


def fields_by_tokens(line):
    """The line as quoted parts, plain parts and commas; parts between commas make a field."""
    parts = [[]]
    for token in TOKEN.finditer(line):
        if token["comma"]:
            parts.append([])
        elif token["plain"]:
            parts[-1].append(token["plain"])
        else:
            body = token["quoted"][1:].replace('""', "\0").replace('"', "")
            parts[-1].append(body.replace("\0", '"'))
    return ["".join(p) for p in parts]


def test_split_fields_on_all_short_texts(spark):
    import itertools

    lines = ["".join(p) for n in range(7) for p in itertools.product('a,"', repeat=n)]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    for row in df.select("value", text.split_fields(F.col("value")).alias("f")).collect():
        assert row["f"] == fields_by_tokens(row["value"]), row["value"]


def test_readable_keeps_schema(spark):
    df = spark.createDataFrame([(1, CANONICAL), (2, "x")], "seq bigint, value string")
    rows = readable(parse_lines(df))
    assert rows.count() == 1 and "parse_error" not in rows.columns


@pytest.mark.parametrize(
    "stamp, month",
    [
        ("2018-08-15 10:00:00", "2018-08"),
        ("2018-08-15T10:00:00", "2018-08"),
        ("2018-08-15T10:00", "2018-08"),
        ("2018-08-15T10:00:00.123456", "2018-08"),
        ("2018-08-15T10:00:00.5", "2018-08"),
        ("invalid-date", "2018-01"),
        ("", "2018-01"),
        (None, "2018-01"),
    ],
)
def test_month_inference(spark, stamp, month):
    assert one(spark, timekeys.inferred_month(F.lit(stamp).cast("string"), "2018-01")) == month


def test_iso_text_leaves_out_zero_seconds(spark):
    at = lambda t: one(spark, timekeys.iso_text(F.lit(t).cast("timestamp_ntz")))
    assert at("2019-05-27 10:00:00") == "2019-05-27T10:00"
    assert at("2019-05-27 10:00:07") == "2019-05-27T10:00:07"


@pytest.mark.parametrize("kmh, band", [(15.0, "good"), (14.99, "med"), (10.0, "med"), (9.9, "bad"), (None, "")])
def test_speed_band(spark, kmh, band):
    assert one(spark, geo.speed_band(F.lit(kmh).cast("double"))) == band


def test_haversine(spark):
    def km(*p):
        return one(spark, geo.haversine_km(*[F.lit(float(x)) for x in p]))

    pair = (3.4210, -76.5205, 3.4512345, -76.5310987)
    lat1, lon1, lat2, lon2 = map(math.radians, pair)
    cosine = math.sin(lat1) * math.sin(lat2) + math.cos(lat1) * math.cos(lat2) * math.cos(lon2 - lon1)
    assert km(*pair) == pytest.approx(6371.0088 * math.acos(cosine), rel=1e-5)
    assert km(*pair) == pytest.approx(km(*pair[2:], *pair[:2]), rel=1e-12)
    assert km(3.4, -76.5, 3.4, -76.5) == 0
    assert km(0, 0, 0, 180) == pytest.approx(20015.1, abs=0.5)


def test_month_sequence_rolls_over(spark):
    months = one(spark, timekeys.months_between("2018-05", "2019-05"))
    assert len(months) == 13 and months[0] == "2018-05" and months[8] == "2019-01" and months[-1] == "2019-05"
    assert one(spark, timekeys.months_between("2018-05", "2018-05")) == ["2018-05"]
    assert one(spark, timekeys.months_between("2018-06", "2018-05")) == []
    assert timekeys.shift_month("2018-01", -1) == "2017-12" and timekeys.shift_month("2018-12", 1) == "2019-01"
