"""Indexes that can stand for each other: built from stored rows, asked for the k nearest."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

from ..types import CollectionConfig
from . import hnsw, ivf
from .knn import knn_batch


class BucketIndex(Protocol):
    """stored(bucket_seq, bucket_start, ts, vector_id, vector); queries(query_id, query)."""

    def build(self, stored: DataFrame) -> None:
        """Make ready for searches of these rows."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vector_id, distance."""


class ExactIndex:
    """A scan of all rows, by any metric that ``knn_batch`` ranks by."""

    def __init__(self, metric: str = "l2sq") -> None:
        self.metric = metric

    def build(self, stored: DataFrame) -> None:
        self.stored = stored

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn_batch(self.stored, queries, k, self.metric)


class GraphIndex:
    """A graph per bucket and shard; the nodes are kept in a folder."""

    def __init__(self, config: CollectionConfig, path: str, ef: int = 100, metric: str = "l2sq") -> None:
        self.config, self.path, self.ef, self.metric = config, path, ef, metric

    def build(self, stored: DataFrame) -> None:
        hnsw.build(stored, self.config, metric=self.metric).write.mode("overwrite").parquet(self.path)
        self.nodes = stored.sparkSession.read.schema(hnsw.NODES).parquet(self.path)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return hnsw.search(self.nodes, queries, self.config, k, self.ef, metric=self.metric).select("query_id", "rank", "vector_id", "distance")


class CellIndex:
    """Cells around centres, of which a query probes some."""

    def __init__(self, cells: int, probe: int) -> None:
        self.cells, self.probe = cells, probe
        self.centres: np.ndarray | None = None

    def build(self, stored: DataFrame) -> None:
        self.stored, self.centres = stored, ivf.train(stored, self.cells)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return ivf.search(self.stored, queries, self.centres, k, self.probe)
