"""Validated ingest: landed lines or datagrams to the lake and to the reject table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetspeed.operators import quality
from fleetspeed.schema import DATAGRAM_SCHEMA
from fleetspeed.sinks.lake import write_lake
from fleetspeed.sinks.live import write_batch
from fleetspeed.sinks.loads import reserve
from fleetspeed.sources.datagrams import parse_lines, place_in_file, starts_of, taken_numbers

NOW = {"availableNow": True}  # run over what has landed, then stop

PASSED_ROWS = 500_000  # about as many rows has a file of the table that is passed on; one task writes it


def batch_files(lines: DataFrame) -> DataFrame:
    """The files of a micro-batch."""
    return lines.select(F.col("file_path").alias("path"), "file_time", F.col("file_size").alias("size")).distinct()


def stamp_batch(lines: DataFrame, first: int, files: int) -> DataFrame:
    """``seq`` from ``first`` for the lines of one micro-batch: files by landing time, lines in file order."""
    # The rows of a micro-batch come straight from the scan, so they are still in file order.
    place = place_in_file(F.col("block_start"))
    if files == 1:  # it starts at the first number
        return lines.select((F.lit(first) + place).alias("seq"), "value")
    starts = starts_of(batch_files(lines), first, "file_time", "path")
    placed = lines.select("value", F.col("file_path").alias("_path"), place.alias("_place"))
    return placed.join(starts, "_path").select((F.col("_start") + F.col("_place")).alias("seq"), "value")


def pass_on(rows: DataFrame, batch_id: int, target: str) -> None:
    """Write one micro-batch as files of consecutive sequence numbers, one after another.

    A stream takes files by the time they were written, and its own micro-batches may end after any of them.  Files that
    tasks write side by side have no such order, so reports of a bus would reach its state out of order.
    """
    pieces = max(1, -(-rows.count() // PASSED_ROWS))
    shares = [k / pieces for k in range(1, pieces)]
    # One number a file; where it is inexact, files differ in size only.
    cuts = sorted(set(rows.agg(F.percentile_approx("seq", shares)).first()[0])) if shares else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        piece = rows if low is None else rows.where(F.col("seq") > low)
        piece = piece if high is None else piece.where(F.col("seq") <= high)
        written = piece.coalesce(1).write.mode("overwrite" if low is None else "append")
        written.parquet(f"{target}/batch_id={batch_id}")


def archive_batch(tagged: DataFrame, batch_id: int, lake: str, rejects: str, accepted: str | None = None) -> None:
    """Accepted rows to the lake, rejected rows with their reason to the reject table.

    With ``accepted`` the accepted rows are also passed on, as a table that the monitoring streams
    read in order of arrival.  A batch owns its directories in all of them, so a repeated batch replaces itself.
    """
    tagged.persist()
    try:
        write_lake(quality.accepted(tagged), lake, f"live-{batch_id}", held=True)
        write_batch(quality.rejected(tagged), rejects, batch_id)
        if accepted:
            kept = quality.accepted(tagged).select(*DATAGRAM_SCHEMA.fieldNames())
            pass_on(kept, batch_id, accepted)
    finally:
        tagged.unpersist()


def _start(stream: DataFrame, sink, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_datagrams(
    datagrams: DataFrame,
    routes: DataFrame,
    lake: str,
    rejects: str,
    checkpoint: str,
    accepted: str | None = None,
    trigger: dict = NOW,
) -> StreamingQuery:
    """Validate a stream of typed datagrams, whose ``seq`` the writer has given."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        archive_batch(quality.with_reject_reason(batch, routes), batch_id, lake, rejects, accepted)

    return _start(datagrams, sink, checkpoint, trigger)


def ingest_lines(
    lines: DataFrame,
    routes: DataFrame,
    lake: str,
    rejects: str,
    checkpoint: str,
    accepted: str | None = None,
    trigger: dict = NOW,
) -> StreamingQuery:
    """Parse and validate a stream of lines (``sources.landing.stream_lines``).

    Each micro-batch is a load of the lake like a bulk load, and numbered behind all before it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        numbers, files = batch_files(batch).agg(taken_numbers(), F.count(F.lit(1))).first()
        first = reserve(batch.sparkSession, lake, f"live-{batch_id}", numbers)
        parsed = parse_lines(stamp_batch(batch, first, files))
        archive_batch(quality.with_reject_reason(parsed, routes), batch_id, lake, rejects, accepted)

    return _start(lines, sink, checkpoint, trigger)
