"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

A document's features are shares and means of its text: letters by case,
digits, marks, symbols, word and line lengths, repeated words and word
triples. Each is cut at quantiles of the fitting rows into steps, so that its
effect need not be a straight line; the values are counted to 1 part in 1024. A pair prefers a document of label 1 to
one of label 0; the chance of a preference is the logistic function of the
difference of their scores, which are linear in the steps, and the weights
minimise the logistic loss over all pairs: what a row is given by all rows of
the other label follows from these rows' scores, counted on a fine grid.

The threshold is a quantile: the score below which as large a share of the
fitting rows lies as has label 0. It maps to 0.7, and the logistic function of
a score's distance from it gives the value from 0 to 1.

Null text is empty; an empty text has all features zero. Without labels of
both kinds every score is the share of label 1 (0 if there are none). Every
text is read whole, and no other column takes part. All labelled rows are
used; the driver holds one byte per feature of each, 21 in all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table, tidy
from .textkernels import buffers, mix, shingles, span_hashes, words
from .training import append_score, fit_rows, remainder, sigmoid

STEPS, CUT = 12, 0.7
GRID = np.linspace(-20, 20, 1601)  # of scores, where pairs are counted
DROPPED = 42  # bits of a value that its count leaves out

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 11, 12, 13),
    "line": (10,),
    "stop": map(ord, ".,;:?'\""),
    "shout": map(ord, "!"),
    "bar": map(ord, "|"),
    "symbol": map(ord, "#$%&*<>{}[]=^~_+/\\@`"),
    "other": range(128, 256),
}
_TABLE = np.zeros(256, np.uint8)
for _k, _class in enumerate(_CLASSES.values()):
    _TABLE[list(_class)] = _k + 1


def _by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct keys, and how often the most frequent one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    _, at, times = np.unique(mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(7))), return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, rows[at], times)
    return np.bincount(rows[at], minlength=n).astype(float), most


def features(column: pa.Array, pieces: int = 1 << 19) -> np.ndarray:
    """One row of features per text."""
    data, offsets = buffers(column)
    out, a = [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + pieces, "right")) - 1)
        out.append(_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        a = b
    return np.concatenate(out) if out else np.zeros((0, 21))


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kind = _TABLE[data]
    size = np.diff(offsets).astype(float)
    count = {name: _by_row(kind == k + 1, offsets) for k, name in enumerate(_CLASSES)}
    letters = count["upper"] + count["lower"] + count["other"]
    starts, ends, first = words(data, offsets)
    rows = np.repeat(np.arange(n), np.diff(first))
    number = np.diff(first).astype(float)
    h = span_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    per = lambda x, y: x / np.maximum(y, 1)
    mean = per(_by_row(length, first), number)
    spread = np.sqrt(np.maximum(0, per(_by_row(length**2, first), number) - mean**2))
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    names = list(_CLASSES)
    odd = (last == names.index("symbol") + 1) | (last == names.index("bar") + 1) | (last == 0)
    triple, begin = shingles(h, first, 3)
    some, most = _distinct(h, rows, n)
    three, most3 = _distinct(triple, np.repeat(np.arange(n), np.diff(begin)), n)
    return np.stack(
        [
            np.log1p(size),
            np.log1p(number),
            mean,
            spread,
            per(count["upper"], letters),
            per(count["digit"], size),
            per(count["stop"], number),
            per(count["shout"], number),
            per(count["bar"], number),
            per(count["symbol"], number),
            per(count["other"], size),
            per(size - sum(count.values()), size),
            per(count["line"], number),
            per(letters, size),
            per(some, number),
            per(most, number),
            per(_by_row(again, first), number),
            per(_by_row(odd, first), number),
            per(three, np.diff(begin)),
            per(most3, np.diff(begin)),
            np.log1p(per(size, count["line"] + 1)),
        ],
        axis=1,
    )


@dataclass
class Model:
    cuts: np.ndarray | None  # features x cuts
    weights: np.ndarray
    threshold: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry scores of feature rows."""
        at = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)
        return self.weights[np.arange(len(self.cuts)), at].sum(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.cuts is None:
            return np.full(len(column), self.threshold)
        return sigmoid(self.rank(features(column)) - self.threshold + math.log(CUT / (1 - CUT)))


def quantile_cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cuts of one feature: values ascend, counts has a column per label."""
    quantiles = np.arange(1, STEPS) / STEPS
    # half of the cuts follow all rows, half the rarer label's rows, whose values lie elsewhere
    rare = counts[:, 1 if counts[:, 1].sum() < counts[:, 0].sum() else 0]
    at = [np.searchsorted(np.cumsum(n), quantiles * n.sum()) for n in (counts.sum(axis=1), rare)]
    return np.sort(values[np.concatenate(at)]) + 1e-9


def _on_grid(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each score and how far on to the next it lies."""
    place = (np.clip(s, GRID[0], GRID[-1]) - GRID[0]) / (GRID[1] - GRID[0])
    low = np.minimum(place.astype(np.int64), len(GRID) - 2)
    return low, place - low


def fit(cuts: np.ndarray, codes: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 2e-4) -> Model:
    """The ranking model of rows' steps (features x rows) and their labels, over all pairs of a row of either label."""
    width = cuts.shape[1] + 1
    beats = sigmoid(GRID[None, :] - GRID[:, None])  # the chance that the column's score beats the row's
    n = [np.count_nonzero(y == v) for v in (0, 1)]
    groups = [np.ascontiguousarray(codes[:, y == v]) for v in (0, 1)]
    w, m, v = (np.zeros((len(cuts), width)) for _ in range(3))
    rank = lambda rows: sum(w[j][c] for j, c in enumerate(rows))
    for t in range(1, rounds + 1):
        places = [_on_grid(rank(rows)) for rows in groups]
        share = [(np.bincount(low, 1 - on, len(GRID)) + np.bincount(low + 1, on, len(GRID))) / k for (low, on), k in zip(places, n, strict=True)]
        slope = ridge * w
        for sign, (low, on), miss, rows, k in zip((1, -1), places, (beats.T @ share[1], beats @ share[0]), groups, n, strict=True):
            own = sign * (miss[low] * (1 - on) + miss[low + 1] * on) / k
            for j, c in enumerate(rows):
                slope[j] += np.bincount(c, own, width)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, w, float(np.quantile(np.concatenate([rank(rows) for rows in groups]), 1 - y.mean())))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels.quality of all rows whose crc32(doc_id) modulo 4 is not 2."""
    bounded_batches(documents.sparkSession)
    rows = fit_rows(documents, labels, "quality", remainder("doc_id", 4) != 2, None)

    def work(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary()), b.column(1)], ["x", "label"])

    read = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(b.num_rows, -1)
    rows = materialize(rows.mapInArrow(tidy(work), "x binary, label int"), "features")

    def count(batches):
        for b in batches:
            x, label = read(b), b.column(1).to_numpy()
            for j in range(x.shape[1] if len(x) else 0):
                key, n = np.unique((x[:, j].copy().view(np.int64) >> DROPPED) << 1 | (label == 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), j), pa.int32()), pa.array(key), pa.array(n, pa.int64())], ["j", "key", "n"])

    counted = rows.mapInArrow(tidy(count), "j int, key long, n long").groupBy("j", "key").agg(F.sum("n").alias("n")).toPandas()
    ones, total = (int(counted["n"][(counted["j"] == 0) & (counted["key"] % 2 >= least)].sum()) for least in (1, 0))
    if not 0 < ones < total:
        return Model(None, np.zeros(0), ones / total if total else 0.0)
    cuts = []
    for _, g in counted.sort_values(["j", "key"]).groupby("j"):
        value, at = np.unique(g["key"].to_numpy() >> 1, return_inverse=True)
        times = np.zeros((len(value), 2))
        np.add.at(times, (at, g["key"].to_numpy() & 1), g["n"].to_numpy())
        cuts.append(quantile_cuts((value << DROPPED).view(np.float64), times))
    cuts = np.stack(cuts)

    def steps(batches):
        for b in batches:
            x = read(b)
            at = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([(b.column(1).to_numpy() == 1).astype(np.uint8).tobytes()], pa.binary())], ["c", "y"])

    seen = rows.mapInArrow(tidy(steps), "c binary, y binary").toArrow()  # 22 bytes a row
    codes = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8).reshape(len(cuts), -1) for c in seen.column(0)], axis=1)
    y = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for c in seen.column(1)])
    order = np.lexsort((*codes, y))  # the rows' order must not matter
    return fit(cuts, codes[:, order], y[order])


def score(documents: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """documents with a value from 0 to 1 that ranks them by quality; CUT is the threshold."""
    return append_score(documents, name, lambda column: model.scores(column))


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model, "score")
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
