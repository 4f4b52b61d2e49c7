"""What the two trained classifiers share: labelled rows and appending a score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, maybe_broadcast, trim

FIT_ROWS = 20_000


def remainder(key: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def fit_rows(documents: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int | None = FIT_ROWS) -> DataFrame:
    """text, label of at most ``bound`` usable labelled documents, taken by a hash of the id; of all without a bound.

    Texts are whole. Ids with several labels count by their least one.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    some = materialize(rows if bound is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "labelled")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(maybe_broadcast(some, 12), "doc_id").select("text", "label")


def append_score(documents: DataFrame, name: str, scores: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """documents with a double column ``name`` made from the text of each row; all other columns pass through."""
    bounded_batches(documents.sparkSession)
    place = documents.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array(scores(b.column(place)), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])
        trim()

    kept = [f for f in documents.schema.fields if f.name != name]
    if len(kept) < len(documents.columns):  # a clashing extra column gives way
        return append_score(documents.drop(name), name, scores, text)
    return documents.mapInArrow(work, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic_line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic regression, with smoothed targets."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = sigmoid(z @ w)
        slope = z.T @ (p - target) + ridge * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
