"""Landing of zipped CSV files of any size.

The bytes of the archives are read by a scan that splits files, so no archive is ever held as a whole.  A
compressed entry can only be unpacked from its start, so the pieces of an archive meet in one task,
sorted there, and pass through it one after the other; many archives are many tasks.  Lines are passed on
in bounded batches.
"""

from __future__ import annotations

import codecs
import io
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.sources.datagrams import starts_of

BATCH_LINES = 10_000
# Spark hands over up to 10 000 rows at once, so this bounds what a task holds at about 80 MB.
PIECE = 1 << 13
ZIPPED = "*.[zZ][iI][pP]"

# Fixed values of the zip format.
_ENTRY, _DESCRIPTOR, _DIRECTORY = b"PK\x03\x04", b"PK\x07\x08", b"PK\x01\x02"
_STORED, _DEFLATED = 0, 8
_ENCRYPTED, _SIZES_FOLLOW = 1, 8
_LARGE = 0xFFFFFFFF


class _Bytes:
    """The bytes of one archive, read forward."""

    def __init__(self, pieces: Iterable[bytes]):
        self._pieces, self._held = iter(pieces), b""

    def some(self) -> bytes:
        """The next bytes, as many as are at hand; none at the end."""
        held, self._held = self._held, b""
        return held or next((p for p in self._pieces if p), b"")

    def back(self, rest: bytes) -> None:
        self._held = rest + self._held

    def exactly(self, size: int) -> bytes:
        found = bytearray()
        for part in self.up_to(size):
            found += part
        return bytes(found)

    def up_to(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in parts."""
        while size:
            part = self.some()
            if not part:
                raise ValueError("archive ends too early")
            self.back(part[size:])
            part = part[:size]
            size -= len(part)
            yield part


def _inflated(source: _Bytes) -> Iterator[bytes]:
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    while not inflate.eof:
        part = source.some()
        if not part:
            raise ValueError("archive ends too early")
        yield inflate.decompress(part)
    source.back(inflate.unused_data)


def _checksum_behind(source: _Bytes) -> int:
    """The checksum of an entry whose sizes follow it; their width is seen by what comes next."""
    first = source.exactly(4)
    checksum = source.exactly(4) if first == _DESCRIPTOR else first
    source.exactly(8)
    following = source.exactly(4)
    if following in (_ENTRY, _DIRECTORY):
        source.back(following)
    else:
        source.exactly(4)
    return int.from_bytes(checksum, "little")


def _entries(source: _Bytes) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Name and content of each entry; a content must be used up before the next entry."""
    while (mark := source.exactly(4)) == _ENTRY:
        flags, method, checksum, packed, _, name_size, extra_size = struct.unpack("<2x2H4x3I2H", source.exactly(26))
        name = source.exactly(name_size).decode("utf-8", "replace")
        extra = source.exactly(extra_size)
        if flags & _ENCRYPTED or method not in (_STORED, _DEFLATED):
            raise ValueError(f"entry is encrypted or packed in an unknown way: {name}")
        if method == _STORED and flags & _SIZES_FOLLOW:
            raise ValueError(f"entry neither tells its size nor is compressed: {name}")
        if method == _STORED and packed == _LARGE:
            packed = _large_size(extra)
        yield name, _verified(source, method, packed, None if flags & _SIZES_FOLLOW else checksum)
    if not mark.startswith(b"PK"):
        raise ValueError("not a zip archive")


def _large_size(extra: bytes) -> int:
    """The compressed size in the field for entries above 4 GiB."""
    while len(extra) >= 4:
        kind, size = struct.unpack("<2H", extra[:4])
        if kind == 1:
            return int.from_bytes(extra[12:20], "little")
        extra = extra[4 + size :]
    raise ValueError("entry does not tell its size")


def _verified(source: _Bytes, method: int, packed: int, checksum: int | None) -> Iterator[bytes]:
    actual = 0
    for part in _inflated(source) if method == _DEFLATED else source.up_to(packed):
        actual = zlib.crc32(part, actual)
        yield part
    if actual != (_checksum_behind(source) if checksum is None else checksum):
        raise ValueError("archive is damaged: the checksum of an entry differs")


def _lines_of(pieces: Iterable[bytes]) -> Iterator[str]:
    """Lines of the first entry named ``*.csv``, whatever ends them."""
    for name, content in _entries(_Bytes(pieces)):
        if not name.lower().endswith(".csv"):
            for _ in content:
                pass
            continue
        decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")(), translate=True)
        held = ""
        for part in content:
            *lines, held = (held + decoder.decode(part)).split("\n")
            yield from lines
        held += decoder.decode(b"", final=True)
        if held:
            yield held.rstrip("\n")
        return
    raise ValueError("no .csv entry inside the archive")


def _batches_of(path: str, pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    first, lines = 0, _lines_of(pieces)
    while values := list(itertools.islice(lines, BATCH_LINES)):
        yield pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path] * len(values), pa.string()),
                "line_no": pa.array(range(first, first + len(values)), pa.int64()),
                "value": pa.array(values, pa.string()),
            }
        )
        first += len(values)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((p.as_py(), c.as_py()) for b in batches for p, c in zip(b["path"], b["content"], strict=True))
    for path, group in itertools.groupby(rows, lambda row: row[0]):
        yield from _batches_of(path, (content for _, content in group))


def unpacked(archives: DataFrame) -> DataFrame:
    """``(path, line_no, value)`` of archives given as ``(path, content)``; each path stands once."""
    return archives.select("path", "content").mapInArrow(_unpack, "path string, line_no bigint, value string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned lines of bytes to numbered pieces of even size, block after block of a file."""
    rows = (row for b in batches for row in zip(b["path"].to_pylist(), b["block"].to_pylist(), b["value"].to_pylist(), strict=True))
    for (path, block), group in itertools.groupby(rows, lambda row: row[:2]):
        for numbered in itertools.batched(enumerate(_even(value for *_, value in group)), 256):
            yield pa.RecordBatch.from_pydict(
                {
                    "path": pa.array([path] * len(numbered), pa.string()),
                    "block": pa.array([block] * len(numbered), pa.int64()),
                    "piece": pa.array([n for n, _ in numbered], pa.int64()),
                    "content": pa.array([c for _, c in numbered], pa.binary()),
                }
            )


def _even(values: Iterator[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for value in values:
        # The end of the file may get one byte too many here, behind all entries.
        held += value + b"\n"
        while len(held) >= PIECE:
            yield bytes(held[:PIECE])
            del held[:PIECE]
    if held:
        yield bytes(held)


def archive_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, line_no, value)`` of all zip archives below the paths.

    An archive without a ``.csv`` entry or with a damaged one is an error; an empty file has no lines.
    """
    # As text cut at one byte value only, bytes come through the scan unchanged, and it splits files.
    scanned = spark.read.options(lineSep="\n", pathGlobFilter=ZIPPED).text(list(paths))
    pieces = scanned.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    ).mapInArrow(_cut, "path string, block bigint, piece bigint, content binary")
    return unpacked(pieces.repartition("path").sortWithinPartitions("path", "block", "piece"))


def land_archives(spark: SparkSession, target: str, *paths: str) -> None:
    """Unpack archives once into a splittable table of lines."""
    archive_lines(spark, *paths).write.mode("append").parquet(target)


def stamp_landed(landed: DataFrame, first: int = 0) -> DataFrame:
    """``seq`` for landed lines: archives in path order, lines in archive order."""
    starts = starts_of(landed.groupBy("path").agg((F.max("line_no") + 1).alias("size")), first)
    placed = landed.withColumnRenamed("path", "_path").join(starts, "_path")
    return placed.select((F.col("_start") + F.col("line_no")).alias("seq"), "value")
