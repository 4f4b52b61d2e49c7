"""Assigning rows to time buckets, and what a set of buckets looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.buckets import slot


def assign(rows: DataFrame, duration: int, mode: str = "arrival", arrival: str = "arrival", ts: str = "ts", newest: int | None = None, chunks: int = 64) -> DataFrame:
    """rows with bucket_start.

    ``event_time``: the row's own window. ``arrival``: a row later than the
    newest bucket opens one, any other goes to the newest so far; ``newest`` is
    the start of the newest bucket before these rows. The running maximum is
    taken in two levels (within ranges of the arrival order, then over the
    ranges' maxima), so that no task holds more than its range.
    """
    own = rows.withColumn("_slot", slot(ts, duration))
    if mode == "event_time":
        return own.withColumnRenamed("_slot", "bucket_start")
    if mode != "arrival":
        raise InvalidArgument(f"unknown routing {mode!r}")
    bounds = rows.agg(F.min(arrival), F.max(arrival)).first()
    if bounds[0] is None:
        return own.withColumnRenamed("_slot", "bucket_start")
    step = max(1, -(-(bounds[1] - bounds[0] + 1) // chunks))
    own = own.withColumn("_range", F.floor((F.col(arrival) - bounds[0]) / step).cast("int"))
    tops = own.groupBy("_range").agg(F.max("_slot").alias("_top"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # ``chunks`` rows
    tops = tops.select("_range", F.max("_top").over(before).alias("_before"))
    within = W.partitionBy("_range").orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    start = F.lit(newest).cast("long")
    joined = own.join(F.broadcast(tops), "_range").withColumn("bucket_start", F.greatest(F.max("_slot").over(within), "_before", start))
    return joined.drop("_slot", "_range", "_before")


def sequence(rows: DataFrame, first: int = 0) -> DataFrame:
    """rows with bucket_seq: bucket starts numbered in ascending order."""
    starts = rows.select("bucket_start").distinct()
    numbered = starts.withColumn("bucket_seq", (F.row_number().over(W.orderBy("bucket_start")) - 1 + first).cast("int"))  # one row per bucket
    return rows.join(F.broadcast(numbered), "bucket_start")


def counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("bucket_seq", "bucket_start").agg(F.count("*").alias("n"))


def metas(stored: DataFrame) -> DataFrame:
    """bucket_seq, bucket_start, newest first."""
    return stored.select("bucket_seq", "bucket_start").distinct().orderBy(F.desc("bucket_seq"))


def recency(kind: str = "none", rate: float = 0.0, now: int | None = None, half_life: float = 1.0, penalties: dict[int, float] | None = None):
    """A function of (bucket_start, distance) Columns.

    ``linear``: distance * (1 + rate * age); ``exp``: distance * 2 ** (age /
    half_life); ``penalty``: distance times the factor set for the bucket
    start, 1 if none is.
    """
    if kind == "none":
        return lambda start, d: d
    if kind == "linear":
        return lambda start, d: d * (1 + rate * (F.lit(now) - start))
    if kind == "exp":
        return lambda start, d: d * F.pow(F.lit(2.0), (F.lit(now) - start) / F.lit(float(half_life)))
    if kind == "penalty":
        table = penalties or {}

        def by_start(start, d):
            factor = F.lit(1.0)
            for s, p in sorted(table.items()):
                factor = F.when(start == s, float(p)).otherwise(factor)
            return d * factor

        return by_start
    raise InvalidArgument(f"unknown recency {kind!r}")


def evict_before(stored: DataFrame, ts: int) -> tuple[DataFrame, int]:
    """What is left without the buckets that start before ts, and how many went."""
    gone = stored.where(F.col("bucket_start") < ts).select("bucket_seq").distinct().count()
    return stored.where(F.col("bucket_start") >= ts), gone


def evict_oldest(stored: DataFrame) -> tuple[DataFrame, int | None]:
    """What is left without the oldest bucket, and its number."""
    oldest = stored.agg(F.min("bucket_seq")).first()[0]
    return (stored, None) if oldest is None else (stored.where(F.col("bucket_seq") != oldest), oldest)
