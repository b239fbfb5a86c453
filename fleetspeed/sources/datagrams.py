"""Datagram lines: arrival order, parsing, and the plain text scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.functions import text
from fleetspeed.functions.timekeys import parse_timestamp
from fleetspeed.operators.ranks import ranked
from fleetspeed.schema import CSV_FIELDS, DATAGRAM_SCHEMA

_INDEX_BITS = 33  # rows per task in monotonically_increasing_id, in Spark 3 and 4

# The row index of a task also counts the files that the task read before.  Each file therefore gets
# this many numbers besides one for each byte: more than a task can have rows, since it reads at
# most spark.sql.files.maxPartitionBytes, which must not be above this.
FILE_ROOM = 1 << 31

# A place in a compressed file is no byte of it, so its lines could run into the next file's numbers.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def files_below(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    """``path`` and ``size`` in bytes of every file of a scan; contents are not read."""
    reader = spark.read.format("binaryFile").options(**options)
    files = reader.load(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size"))
    packed = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*COMPRESSED)).first()
    if packed:
        raise ValueError(f"unpack compressed files before a load: {packed['path']}")
    return files


def place_in_file(block_start: Column) -> Column:
    """A number that grows line by line within a file, for a frame in scan order.

    It adds the row index of the task to the byte offset of its block.  A line is at least one
    byte long and a whole block fills a task, so its places end before the next block of the file
    starts.  Only a file's last block can share a task with other files.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return block_start + index


def taken_numbers() -> Column:
    """How many numbers files of these sizes take."""
    return F.coalesce(F.sum(F.col("size") + FILE_ROOM), F.lit(0))


def numbers_of(files: DataFrame) -> int:
    return files.agg(taken_numbers()).first()[0]


def starts_of(files: DataFrame, first: int, *order: str) -> DataFrame:
    """Where the numbers of each file start, file after file: prefix sums over ranges of the order."""
    taken = files.withColumn("_taken", F.col("size") + FILE_ROOM)
    summed = ranked(files.sparkSession, taken, [], [F.col(c) for c in order or ("path",)], "_before", "_taken")
    return summed.select(F.col("path").alias("_path"), (F.lit(first) + F.col("_before")).alias("_start"))


def stamp_arrival(lines: DataFrame, files: DataFrame, first: int = 0) -> DataFrame:
    """Add ``seq`` to a text scan: files in path order, lines in file order.

    A line's number is ``first``, plus the numbers of all files before its own, plus its place in
    the file.
    """
    place = place_in_file(F.col("_metadata.file_block_start"))
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"), place.alias("_place"))
    starts = starts_of(files, first)
    return placed.join(starts, "_path").select((F.col("_start") + F.col("_place")).alias("seq"), "value")


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed datagrams from CSV lines; other columns (``seq``) are kept.

    Every line gives one row.  ``parse_error`` is NULL for a readable line, else it says
    whether the field count or a field is wrong; the fields of such a row may be NULL.
    """
    kept = [c for c in lines.columns if c != value]
    # The generator in ``once`` also keeps the split from being copied into every field.
    split = lines.select(*kept, value, text.split_fields(F.col(value)).alias("_f"))
    typed = F.struct(*[_typed(i, name).alias(name) for i, name in enumerate(CSV_FIELDS)])
    rows = once(split, typed, "_row")
    broken = F.lit(False)
    for name in CSV_FIELDS:
        broken = broken | F.col("_row")[name].isNull()
    error = F.when(F.size("_f") != len(CSV_FIELDS), F.lit("FieldCount")).when(
        broken, F.lit("FieldFormat")
    )
    return rows.select(*kept, value, "_row.*", error.alias("parse_error"))


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once per row.

    The optimizer copies a plain projected expression into every later use of it, filters
    included; it does not look through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _typed(place: int, name: str) -> Column:
    field = F.get("_f", F.lit(place))
    kind = DATAGRAM_SCHEMA[name].dataType.typeName()
    # Casts to numbers ignore blanks around the text by themselves.
    if kind == "integer":
        return text.to_int(field)
    if kind == "long":
        return text.to_long_lenient(field)
    if kind == "timestamp_ntz":
        return parse_timestamp(text.trimmed(field))
    return text.trimmed(field)


def readable(parsed: DataFrame) -> DataFrame:
    """Only the rows that could be read, in the datagram schema."""
    names = [n for n in DATAGRAM_SCHEMA.fieldNames() if n in parsed.columns]
    return parsed.where(F.col("parse_error").isNull()).select(*names)


def scan_lines(spark: SparkSession, *paths: str, first: int = 0, **options: str) -> DataFrame:
    """All lines with their sequence number from ``first``, unreadable ones included."""
    files = files_below(spark, *paths, **options)
    return stamp_arrival(spark.read.options(**options).text(list(paths)), files, first)


def scan_datagrams(spark: SparkSession, *paths: str) -> DataFrame:
    """Readable datagrams of headerless CSV files."""
    return readable(parse_lines(scan_lines(spark, *paths)))


def to_line() -> Column:
    """The CSV line of a datagram row (inverse of ``parse_lines``)."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws(",", *[stamp if n == "ts" else F.col(n) for n in CSV_FIELDS])
