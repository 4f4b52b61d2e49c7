"""Idempotent ingest: validation, first-write-wins, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def validate(rows: DataFrame, dim: int) -> tuple[int, int | None, int | None]:
    """Reject the whole batch if a vector is null, empty or of another dimension, or an id or time is missing; (rows, least id, greatest id)."""
    size = F.size("vector")
    bad = rows.agg(
        F.count_if(F.col("vector").isNull() | (size <= 0)).alias("empty"),
        F.count_if(size != dim).alias("dim"),
        F.count_if(F.col("vector_id").isNull() | F.col("ts").isNull()).alias("missing"),
        F.count_if((F.col("vector_id") < 0) | (F.col("ts") < 0)).alias("negative"),
        F.count("*").alias("rows"),
        F.min("vector_id").alias("least"),
        F.max("vector_id").alias("most"),
    ).first()
    if bad["empty"]:
        raise InvalidArgument(f"{bad['empty']} empty vectors")
    if bad["dim"]:
        raise InvalidArgument(f"{bad['dim']} vectors are not of dimension {dim}")
    if bad["missing"] or bad["negative"]:
        raise InvalidArgument("ids and times must be given, from 0 to 2**63 - 1")
    return bad["rows"], bad["least"], bad["most"]


def first_wins(rows: DataFrame, key: str = "vector_id", arrival: str = "arrival") -> DataFrame:
    """Per id the row that arrived first."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(arrival))
    return rows.withColumn("_first", rank).where("_first = 1").drop("_first")


def accepted(rows: DataFrame, known: DataFrame | None, key: str = "vector_id", arrival: str = "arrival") -> DataFrame:
    """The rows an insert takes: the first of each id that is not yet known."""
    fresh = rows if known is None else rows.join(known.select(key).distinct(), key, "left_anti")
    return first_wins(fresh, key, arrival)


def skipped(rows: DataFrame, known: DataFrame | None, key: str = "vector_id", arrival: str = "arrival") -> DataFrame:
    """The rows an insert leaves out."""
    return rows.join(accepted(rows, known, key, arrival).select(arrival), arrival, "left_anti")


def replay(snapshot: DataFrame, log: DataFrame, after_seq: int, key: str = "vector_id") -> DataFrame:
    """Snapshot rows and the log's rows behind after_seq, the first of each id; snapshot rows come first."""
    tail = log.where(F.col("seq") > after_seq)
    both = snapshot.withColumn("seq", F.lit(-1).cast("long")).withColumn("position", F.lit(0).cast("long")).unionByName(tail)
    rank = F.row_number().over(W.partitionBy(key).orderBy("seq", "position"))
    return both.withColumn("_first", rank).where("_first = 1").drop("_first")


def dirty(stored: DataFrame, watermarks: DataFrame) -> DataFrame:
    """bucket_seq, dirty: rows of each bucket beyond what its last snapshot held."""
    now = stored.groupBy("bucket_seq").agg(F.count("*").alias("n"))
    return now.join(watermarks, "bucket_seq", "left").select("bucket_seq", (F.col("n") - F.coalesce("clean", F.lit(0))).alias("dirty"))


def stale(listed: DataFrame, live: DataFrame, on: str) -> DataFrame:
    """What is listed but not live."""
    return listed.join(live, on, "left_anti")
