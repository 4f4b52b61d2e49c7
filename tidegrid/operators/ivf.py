"""Inverted-file search: k-means cells, of which a query probes the nearest few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn_batch


def train(corpus: DataFrame, cells: int, vector_col: str = "vector", seed: int = 7, rounds: int = 10) -> np.ndarray:
    """The cells' centres."""
    points = corpus.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=rounds).fit(points).clusterCenters())


def assign(corpus: DataFrame, centres: np.ndarray, vector_col: str = "vector", n: int = 1, name: str = "cell") -> DataFrame:
    """corpus with its n nearest cells as an array."""
    place = corpus.columns.index(vector_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in corpus.dtypes) + f", {name} array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            far = (centres * centres).sum(axis=1)[None, :] - 2 * flat @ centres.T
            near = np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near), pa.list_(pa.int32()))], names=[*b.schema.names, name])

    return corpus.mapInArrow(work, schema)


def search(corpus: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probe: int, id_col: str = "vector_id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank, id, distance of the k nearest in the probed cells. The corpus stays where it is."""
    return knn_batch(corpus, queries, k, id_col=id_col, vector_col=vector_col, cells=(centres, probe))
