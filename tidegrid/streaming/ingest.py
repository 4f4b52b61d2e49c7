"""Structured Streaming ingest: the batch path in foreachBatch, exactly once by idempotence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest(stream: DataFrame, engine: Engine, collection: str, checkpoint: str, available_now: bool = True, interval: str = "1 second", mode: str = "arrival") -> StreamingQuery:
    """Insert a stream of (vector_id, ts, vector) micro-batch by micro-batch.

    A micro-batch that is sent again adds nothing, as its ids are known.
    """

    def insert(batch: DataFrame, _: int) -> None:
        engine.batch_insert(collection, batch, mode)

    writer = stream.select("vector_id", "ts", "vector").writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def snapshots(stream: DataFrame, engine: Engine, collection: str, checkpoint: str, min_dirty: int) -> StreamingQuery:
    """Ingest that snapshots the collection whenever min_dirty new rows have come together."""

    def insert(batch: DataFrame, _: int) -> None:
        engine.batch_insert(collection, batch)
        engine.snapshot(collection, min_dirty)

    return stream.select("vector_id", "ts", "vector").writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, ts: str, duration: str, late: str, key: str | None = None) -> DataFrame:
    """Rows per tumbling window (and key), closed once the watermark has passed."""
    by = [F.window(ts, duration)] + ([key] if key else [])
    rows = events.withWatermark(ts, late).groupBy(*by).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), *([key] if key else []), "n")


def first_seen(stream: DataFrame, ts: str, late: str, key: str = "vector_id") -> DataFrame:
    """The first row of each id within the lateness bound, as a stream."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
