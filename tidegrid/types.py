"""Schemas and the configuration of a collection."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from .errors import InvalidArgument

FOREVER = (1 << 63) - 1  # one bucket for all time

VECTOR = T.ArrayType(T.FloatType(), False)
VECTORS = T.StructType([T.StructField("vector_id", T.LongType(), False), T.StructField("ts", T.LongType(), False), T.StructField("vector", VECTOR, False)])
STORED = T.StructType([*VECTORS.fields, T.StructField("bucket_seq", T.IntegerType()), T.StructField("bucket_start", T.LongType())])
HITS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("vector_id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ]
)
METRICS = ("l2sq", "l2", "dot", "neg_dot", "cosine")


@dataclass(frozen=True)
class CollectionConfig:
    """What a collection is created with; a bucket duration of 0 means one endless bucket."""

    dim: int
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 100
    bucket_duration_secs: int = 0

    def validated(self) -> CollectionConfig:
        # The messages.
        checks = (
            (self.dim > 0, "dim must be > 0"),
            (self.m >= 2, "m must be >= 2"),
            (self.m_max0 >= self.m, "m_max0 must be >= m"),
            (self.ef_construction >= self.m, "ef_construction must be >= m"),
            (self.bucket_duration_secs >= 0, "bucket_duration must be >= 0"),
        )
        for good, message in checks:
            if not good:
                raise InvalidArgument(message)
        return self

    @property
    def duration(self) -> int:
        return self.bucket_duration_secs or FOREVER

    def to_dict(self) -> dict:
        return asdict(self)
