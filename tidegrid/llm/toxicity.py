"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The unit is a white-space token, or a run of three and more tokens of one
letter ("i d i o t"). It is read as letters: case and marks between letters
fall away, digits that stand for letters become them, a mark says where it
begins. The kernel counts the common subsequences of three letters, each step
skipping up to two letters at a price of ``DECAY`` apiece, so that gapped and
inserted characters lower the likeness but do not end it; it is scaled by the
units' own weight.

Labels are on documents, so the evidence is gathered first. Candidates are the
units that occur in toxic documents nearly alone, more often than chance among
all units could explain. Copies of a toxic document make all its rare words
candidates, so the fewest candidates that explain the toxic documents are
chosen greedily as positive examples; units of clean documents are negative.
Candidates that the machine then puts on the toxic side become positive too,
and each short positive also counts with a letter inserted or doubled, so that
the machine learns how far gaps and insertions may lower the likeness.
The kernel against ``LANDMARKS`` units is whitened by its eigenvectors
(Nystroem) and a linear machine with squared hinge loss fitted by Newton
steps; then the clean units that it scores highest join the negatives and it
is fitted anew. As the machine is linear in subsequence counts, its landmarks
fold into one weight per subsequence: scoring costs nine look-ups per letter.

A document's margin is that of its highest unit, made a probability by the
slope of a logistic line over the fitting rows around a threshold between
their clean margins and the machine's target. A text without units, null or empty, has
the lowest margin. Without labels of both kinds every score is the share of
toxic labels (0 if there are none). Every text is read whole, and no other
column takes part. ``FIT_ROWS`` labelled rows at most, taken by a hash of
their ids, are used to fit; all bounds below are on what the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table, tidy
from .textkernels import buffers, mix, ranges, span_hashes, words
from .training import FIT_ROWS, append_score, fit_rows, logistic_line, remainder, sigmoid

LANDMARKS, DECAY, STEPS = 192, 0.5, (1, 2, 3)
POSITIVES, NEGATIVES, HARD, COST = 3000, 12_000, 3000, 20.0
LOWEST = -4.0
MIXED = 5
PIECES = 1 << 19  # bytes of text worked on at a time
BEGIN = 63

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = np.arange(1, 27)
_LETTERS[65:91] = np.arange(1, 27)
for _digit, _letter in zip("0134578@", "oieastba", strict=True):  # fixed values: digits that stand for letters
    _LETTERS[ord(_digit)] = ord(_letter) - 96


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all units, the starts ascending."""
    starts, ends, first = words(data, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    single = (ends - starts == 1) & (_LETTERS[data[starts]] > 0) if len(starts) else np.zeros(0, bool)
    if single.any():
        linked = single[1:] & single[:-1] & (rows[1:] == rows[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
        a, b = edge[::2], edge[1::2]
        long = b - a >= 2
        a, b = a[long], b[long]
        starts, ends, rows = np.concatenate((starts, starts[a])), np.concatenate((ends, ends[b])), np.concatenate((rows, rows[a]))
        order = np.argsort(starts, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
    return starts, ends, rows


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units' letters (1 to 62, each unit after the mark BEGIN), and where each unit begins (with an end mark)."""
    lengths = ends - starts
    begin = np.concatenate(([0], np.cumsum(lengths)))
    unit = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(begin[-1]) - begin[:-1][unit] + starts[unit]
    raw = data[at]
    found = _LETTERS[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):  # a letter of several bytes: one of 36 classes by its first two, capitals of Latin-1 as small ones
        nxt = data[np.minimum(at[lead] + 1, len(data) - 1)].astype(np.int64)
        one = raw[lead].astype(np.int64)
        nxt = np.where((one == 0xC3) & (nxt < 0x9F), nxt | 0x20, nxt)
        found[lead] = (27 + (one * 7 + nxt * 11) % 36).astype(np.uint8)
    keep = found > 0
    count = np.bincount(unit[keep], minlength=len(starts))
    where = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.empty(where[-1], np.uint8)
    mark = np.zeros(where[-1], bool)
    mark[where[:-1]] = True
    out[mark] = BEGIN
    out[~mark] = found[keep]
    return out, where


def triples(flat: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, subsequence, weight) of all subsequences, by the lengths of their two steps."""
    unit = np.repeat(np.arange(len(where) - 1), np.diff(where))
    wide = flat.astype(np.int64)
    for d in STEPS:
        for e in STEPS:
            n = len(flat) - d - e
            if n <= 0:
                continue
            same = np.flatnonzero(unit[:n] == unit[d + e :])
            yield unit[same], wide[same] << 12 | wide[same + d] << 6 | wide[same + d + e], DECAY ** (d + e - 2)


def norms(where: np.ndarray) -> np.ndarray:
    length = np.diff(where)
    total = sum(DECAY ** (2 * (d + e - 2)) * np.maximum(0, length - d - e) for d in STEPS for e in STEPS)
    return np.sqrt(np.maximum(total, DECAY**8))


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float
    slope: float
    offset: float

    def margins(self, flat: np.ndarray, where: np.ndarray) -> np.ndarray:
        total = np.zeros(len(where) - 1)
        for unit, sub, weight in triples(flat, where):
            total += weight * np.bincount(unit, self.weights[sub], len(total))
        return total / norms(where) + self.bias

    def highest(self, column: pa.Array, pieces: int = PIECES) -> np.ndarray:
        """The highest margin of each row's units."""
        out = np.full(len(column), LOWEST)
        data, offsets = buffers(column)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + pieces, "right")) - 1)
            part = data[offsets[a] : offsets[b]]
            starts, ends, rows = units(part, offsets[a : b + 1] - offsets[a])
            if len(starts):
                _, at, back = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
                margin = self.margins(*letters(part, starts[at], ends[at]))[back]
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                out[a + rows[first]] = np.maximum(LOWEST, np.maximum.reduceat(margin, first))
            a = b
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.offset)
        return sigmoid(self.slope * self.highest(column) + self.offset)


def count_units(rows: DataFrame) -> DataFrame:
    """unit (its letters), toxic, clean: in how many of the rows(text, label) of either label it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, j - i) for x in batches for i, j in ranges(x.column(0), PIECES)):
            data, offsets = buffers(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            starts, ends, row = units(data, offsets)
            h = span_hashes(data, starts, ends)
            _, once = np.unique(mix(h ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            _, at, back = np.unique(h[once], return_index=True, return_inverse=True)
            flat, where = letters(data, starts[once][at], ends[once][at])
            toxic = np.bincount(back, label[row[once]] == 1, len(at)).astype(np.int64)
            total = np.bincount(back, minlength=len(at)).astype(np.int64)
            whole = flat.tobytes()
            names = [whole[i:j] for i, j in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(toxic), pa.array(total - toxic)], ["unit", "toxic", "clean"])

    made = rows.select("text", "label").mapInArrow(tidy(work), "unit binary, toxic long, clean long")
    return made.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.length("unit") > 2)


def explain(rows: DataFrame, candidates: list[bytes]) -> list[bytes]:
    """The fewest candidates, greedily, that occur in the toxic rows that hold any; equal texts count once.

    Then those that occur with at least ``MIXED`` different sets of these: the
    words that one text's copies share always meet the same set.
    """
    place = {u: k for k, u in enumerate(candidates)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, j - i) for x in batches for i, j in ranges(x.column(0), PIECES)):
            data, offsets = buffers(b.column(0))
            starts, ends, row = units(data, offsets)
            _, once = np.unique(mix(span_hashes(data, starts, ends) ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
            flat, where = letters(data, starts[once], ends[once])
            whole, held = flat.tobytes(), [set() for _ in range(len(b.column(0)))]
            for r, i, j in zip(row[once].tolist(), where[:-1].tolist(), where[1:].tolist(), strict=True):
                if (k := place.get(whole[i:j])) is not None:
                    held[r].add(k)
            yield pa.RecordBatch.from_arrays([pa.array([sorted(h) for h in held], pa.list_(pa.int32())), b.column(1)], ["held", "h"])

    toxic = rows.where("label = 1").select("text", F.xxhash64("text").alias("h"))
    lists = toxic.mapInArrow(tidy(work), "held array<int>, h long").where(F.size("held") > 0).distinct()
    all_ = [set(r[0]) for r in lists.collect()]  # of the toxic among the fitting rows
    open_, least, chosen = all_, 2 if len(all_) < 200 else 3, []
    while open_:
        gain = np.zeros(len(candidates), np.int64)
        for h in open_:
            gain[list(h)] += 1
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        open_ = [h for h in open_ if best not in h]
    some = set(chosen)
    met: list[set] = [set() for _ in candidates]
    for h in all_:
        company = frozenset(h & some)
        for k in h - some:
            met[k].add(company)
    return [candidates[k] for k in chosen] + [u for u, m in zip(candidates, met, strict=True) if len(m) >= MIXED]


def disguised(unit: bytes) -> list[bytes]:
    """The unit with one letter inserted or doubled inside, if it has 4 to 12 letters."""
    if not 5 <= len(unit) <= 13:
        return []
    return [unit[:k] + x + unit[k:] for k in range(2, len(unit)) for x in (bytes([24]), unit[k - 1 : k])]


def _flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), np.uint8), np.concatenate(([0], np.cumsum([len(u) for u in found]))).astype(np.int64)


def machine(positive: list[bytes], negative: list[bytes], landmarks: list[bytes], cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights per subsequence and the bias of the machine over the landmarks' kernel."""
    flat, where = _flat(landmarks)
    subs = np.unique(np.concatenate([s for _, s, _ in triples(flat, where)]))
    place = np.full(1 << 18, -1, np.int64)
    place[subs] = np.arange(len(subs))

    def features(found: list[bytes]) -> np.ndarray:
        flat, where = _flat(found)
        out = np.zeros((len(found), len(subs)), np.float32)
        for unit, sub, weight in triples(flat, where):
            known = place[sub] >= 0
            np.add.at(out, (unit[known], place[sub[known]]), weight)
        return out / norms(where)[:, None].astype(np.float32)

    base = features(landmarks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-5 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    everything = positive + negative
    x = np.concatenate([features(everything[k : k + 500]) @ base.T for k in range(0, len(everything), 500)]).astype(np.float64) @ whiten
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.where(y > 0, len(negative) / max(1, len(positive)), 1.0) ** 0.5 * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w) < 1
        xi = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + xi.T @ x[inside], xi.T @ y[inside])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    table_ = np.zeros(1 << 18)
    table_[subs] = base.T.astype(np.float64) @ (whiten @ w[:-1])
    return table_, float(w[-1])


def train(documents: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Fit on labels.toxic of rows whose crc32(doc_id) modulo 5 is not 0."""
    bounded_batches(documents.sparkSession)
    rows = materialize(fit_rows(documents, labels, "toxic", remainder("doc_id", 5) != 0, bound), "fit")
    sizes = dict(rows.groupBy("label").count().collect())
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    if not 0 < toxic < total:
        return Model(None, 0.0, 0.0, toxic / total if total else 0.0)
    vocabulary = materialize(count_units(rows), "units")
    rate = toxic / total
    # so often in toxic documents alone that among all units not one would be by chance
    least = max(3, math.ceil(math.log(max(2, vocabulary.count()) / 0.05) / math.log(1 / rate)))
    sure = F.col("toxic") >= 9 * F.col("clean")
    take = lambda df, n: [bytes(r[0]) for r in df.limit(n).collect()]
    candidates = take(vocabulary.where(sure & (F.col("toxic") >= least)).orderBy(F.desc("toxic"), "unit").select("unit"), POSITIVES)
    positive = explain(rows, candidates)
    if not positive:
        positive = take(vocabulary.where("toxic >= clean and toxic > 1").orderBy(F.desc("toxic"), "unit").select("unit"), 20)
    if not positive:
        return Model(None, 0.0, 0.0, rate)
    plain = vocabulary.where(F.col("clean") * rate >= F.col("toxic") * (1 - rate) * 0.3).where("clean > 0")
    common = take(plain.orderBy(F.desc("clean"), "unit").select("unit"), NEGATIVES // 4)
    negative = sorted({*common, *take(plain.orderBy(F.xxhash64("unit"), "unit").select("unit"), NEGATIVES)})
    spread = lambda units, n: [units[int(k)] for k in np.unique(np.linspace(0, len(units) - 1, min(n, len(units))))]
    head = positive[: LANDMARKS // 4]
    landmarks = [*head, *spread(positive[len(head) :] or head, LANDMARKS // 4), *spread(negative, LANDMARKS // 2)]
    landmarks = list(dict.fromkeys(landmarks))
    known = {*negative}
    varied = lambda: sorted({*positive, *(v for u in positive for v in disguised(u) if v not in known)})
    for _ in range(2):
        weights, bias = machine(varied(), negative, landmarks)
        model = Model(weights, bias, 1.0, 0.0)

        def rate_units(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.margins(*_flat(b.column(0).to_pylist())))], ["unit", "margin"])

        rated = plain.select("unit").mapInArrow(rate_units, "unit binary, margin double")
        hard = take(rated.orderBy(F.desc("margin"), "unit").select("unit"), HARD)
        negative = sorted({*negative, *hard})
        known |= {*hard}
        landmarks = list(dict.fromkeys([*landmarks, *hard[: LANDMARKS // 8]]))
        if candidates:
            margin = model.margins(*_flat(candidates))
            positive = sorted({*positive, *(u for u, m in zip(candidates, margin, strict=True) if m > 0)})
    weights, bias = machine(varied(), negative, landmarks)
    model = Model(weights.astype(np.float32), bias, 1.0, 0.0)
    seen = append_score(rows, "margin", lambda column: model.highest(column)).select("margin", "label").toPandas()  # ``bound`` rows at most
    margin, label = seen["margin"].to_numpy(), seen["label"].to_numpy()
    model.slope, model.offset = logistic_line(margin, label)
    # the machine aims at 1 for positives, disguised ones too: halfway there from where clean rows end, if that is lower
    end = float(np.quantile(margin[label == 0], 0.999))
    if end < 1 and model.slope > 0:
        model.offset = -model.slope * min(-model.offset / model.slope, max(0.0, (end + 1) / 2))
    return model


def score(documents: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """documents with the probability that each is toxic."""
    return append_score(documents, name, lambda column: model.scores(column))


def query(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model, "score")
    held = (remainder("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
