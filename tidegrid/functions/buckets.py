"""Time-bucket arithmetic on a grid anchored at the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(ts: Column | str, duration: int) -> Column:
    """Start of the bucket that ts falls into."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts - F.pmod(ts, F.lit(duration))).cast("long")


def slot_of(ts: int, duration: int) -> int:
    return ts - ts % duration


def in_range(bucket_start: Column | str, start: int | None, end: int | None, duration: int) -> Column:
    """Whether a bucket overlaps [start, end): all its rows are candidates.

    Without both bounds every bucket is; an empty range has none. The bounds
    become bucket starts here, so that the predicate prunes partitions.
    """
    b = F.col(bucket_start) if isinstance(bucket_start, str) else bucket_start
    if start is None or end is None:
        return F.lit(True)
    if start >= end:
        return F.lit(False)
    return b.between(slot_of(start, duration), slot_of(end - 1, duration))
