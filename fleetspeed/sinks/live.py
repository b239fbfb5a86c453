"""Live outputs: one update per consumed datagram, one alert per exceptional one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from fleetspeed.operators.monitoring import critical_alerts


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_stream(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append rows to a Parquet table, exactly once through the sink's own log."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )


def write_updates_and_alerts(batch: DataFrame, batch_id: int, updates: str, alerts: str) -> None:
    """Both live tables from one batch of updates that carry their ``event_type``."""
    batch.persist()
    try:
        write_batch(batch.drop("event_type"), updates, batch_id)
        write_batch(critical_alerts(batch), alerts, batch_id)
    finally:
        batch.unpersist()
