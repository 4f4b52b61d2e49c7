"""Exact nearest neighbours: a block kernel over Arrow batches, and top-k plans.

The corpus is scanned once and never shuffled: each batch meets the queries in
blocks of at most ``CELLS`` pairs and keeps k candidates per query, so a task
sends at most k rows per query and batch; what is farther than the k nearest
that the task has seen is left out. A window ranks what is left per query,
cutting to k before the shuffle. A task holds at most ``QUERY_MB`` of queries;
more are cut into chunks that meet the corpus one after another. Exact
distances are computed for ``EXACT_MB`` of vectors at a time and sent on every
``OUT_ROWS`` rows, so a task's memory depends on none of the number of queries,
rows and k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import distance
from ..types import METRICS

QUERY_MB = 32
CELLS, OUT_ROWS = 1 << 20, 1 << 16
EXACT_MB, BOUND_MB = 4, 32
INTEGERS = ("tinyint", "smallint", "int", "bigint")
SLACK = 1e-6
EPS = float(np.finfo(np.float64).eps)


def top_k(hits: DataFrame, k: int, keys: list[str | Column], order: list[str | Column], name: str = "rank") -> DataFrame:
    """The first k rows per key in the order, with their rank from 1."""
    if k < 0:
        raise InvalidArgument("k must not be negative")
    if k == 0:
        return hits.withColumn(name, F.lit(0)).limit(0)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return hits.withColumn(name, rank).where(F.col(name) <= k)


def knn_single(corpus: DataFrame, query: list[float], k: int, metric: str = "l2sq", id_col: str = "vector_id", vector_col: str = "vector") -> DataFrame:
    """rank, id, distance of the k nearest to one vector, by column functions alone."""
    if k < 1:
        raise InvalidArgument("k must be at least 1")
    if not query:
        raise InvalidArgument("the query is empty")
    by = "dot" if metric == "dot" else metric
    literal = F.array(*[F.lit(float(x)) for x in query])
    found = corpus.select(id_col, distance(vector_col, literal, by).alias("distance"))
    order = [F.desc("distance") if metric == "dot" else F.asc("distance"), F.asc(id_col)]
    nearest = found.orderBy(*order).limit(k)
    return nearest.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("rank", id_col, "distance")  # k rows


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, adding from the first component to the last."""
    total, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        if metric in ("l2sq", "l2"):
            d = a[:, j] - b[:, j]
            total += d * d
        else:
            total += a[:, j] * b[:, j]
            if metric == "cosine":
                aa += a[:, j] * a[:, j]
                bb += b[:, j] * b[:, j]
    if metric == "l2":
        return np.sqrt(total)
    if metric == "neg_dot":
        return -total
    if metric == "cosine":
        both = np.sqrt(aa) * np.sqrt(bb)
        return np.where(both == 0, 1.0, 1.0 - total / np.where(both == 0, 1.0, both))
    return total


def _middle(queries: np.ndarray, metric: str) -> np.ndarray:
    """What differences are taken from, so that an offset that all vectors share costs no digits."""
    fine = queries[np.isfinite(queries).all(axis=1)]
    return fine.mean(axis=0) if metric in ("l2sq", "l2") and len(fine) else np.zeros(queries.shape[1])


def _rough(queries: np.ndarray, block: np.ndarray, middle: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending with the distance, by one matrix product, and per query how far rounding can put it off; both less the middle."""
    lost = 4 * EPS * float(np.abs(middle).max(initial=0.0)) * np.sqrt(queries.shape[1])
    product = queries @ block.T
    qq, bb = (queries * queries).sum(axis=1), (block * block).sum(axis=1)
    most = bb[np.isfinite(bb)].max(initial=0.0)
    if metric in ("l2sq", "l2"):
        product *= -2
        product += qq[:, None]
        product += bb[None, :]
        return product, 8 * queries.shape[1] * EPS * (qq + most) + 4 * lost * (np.sqrt(qq) + np.sqrt(most))
    if metric == "cosine":
        qq, bb = np.sqrt(qq), np.sqrt(bb)
        product /= -np.where(qq == 0, 1.0, qq)[:, None]
        product /= np.where(bb == 0, 1.0, bb)[None, :]
        product += 1  # 1 of a zero vector, whose product is 0
        return product, np.full(len(qq), 8 * queries.shape[1] * EPS)
    return np.negative(product, out=product), 8 * queries.shape[1] * EPS * np.sqrt(qq * most)


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2sq",
    id_col: str = "vector_id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_col: str = "query",
    exclude_self: bool = False,
    keep: tuple[str, ...] = (),
    per: tuple[str, ...] = (),
    adjust: Column | None = None,
    order: tuple[str, ...] = (),
    cells: tuple[np.ndarray, int] | None = None,
    overall: bool = True,
) -> DataFrame:
    """query_id, rank, id, distance (and the kept corpus columns) of each query's k nearest.

    ``per``: corpus columns within which the first cut to k is made (such as
    the bucket). ``adjust``: a Column of "distance" and kept columns that
    replaces the distance before the last cut. ``cells``: centres, and how many
    of their cells a query looks into. ``overall=False``: the k nearest of every
    ``per`` group, ranked within it. Ties go to ``order``, then the
    id. Vectors of another dimension than the queries' raise an error.
    """
    if k < 1:
        raise InvalidArgument("k must be at least 1")
    if metric not in METRICS or metric == "dot":
        raise InvalidArgument(f"cannot rank by {metric!r}")
    rows = queries.select(F.col(query_id).cast("long"), F.col(query_col).cast("array<double>"))
    count, width = rows.count(), rows.select(F.max(F.size(F.col(query_col)))).first()[0]
    columns = list(dict.fromkeys([*keep, *per, *[c for c in order if c != "distance"]]))
    types = dict(corpus.dtypes)
    schema = ", ".join([f"{query_id} long", f"{id_col} long", "distance double", *[f"{c} {types[c]}" for c in columns]])
    if not count:
        return corpus.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    chunk = max(1, (QUERY_MB << 20) // (8 * max(1, width)))
    ties = [*order, id_col]
    ranks = [c for c in ties if c != id_col] if all(types.get(c) in INTEGERS for c in ties) else None
    found = None
    for held in query_chunks(rows, query_id, count, chunk):
        made = _scan(corpus, held[query_id].to_numpy(), np.stack(held[query_col].to_numpy()).astype(np.float64), k, metric, id_col, vector_col, columns, per, exclude_self, schema, cells, ranks)
        found = made if found is None else found.unionByName(made)
    if per and (overall or adjust is not None):
        found = top_k(found, k, [query_id, *per], ["distance", *ties], "_first").drop("_first")
    if adjust is not None:
        found = found.withColumn("distance", adjust.cast("double"))
    return top_k(found, k, [query_id, *([] if overall else per)], ["distance", *ties]).select(query_id, "rank", id_col, "distance", *columns)


def query_chunks(rows: DataFrame, query_id: str, count: int, chunk: int):
    """The queries as pandas tables of about ``chunk`` rows at most, dealt by a hash of the id: one id is in one of them."""
    if count <= chunk:
        yield rows.toPandas()
        return
    chunks = -(-9 * count // (8 * chunk))
    for k in range(chunks):
        held = rows.where(F.pmod(F.xxhash64(query_id), F.lit(chunks)) == k).toPandas()
        if len(held):
            yield held


def _scan(corpus, ids, matrix, k, metric, id_col, vector_col, columns, per, exclude_self, schema, cells, ranks) -> DataFrame:
    """The candidates of one chunk of queries. ``ranks``: the columns before the id by which ties are cut here, None where the window alone cuts them."""
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((ids, matrix))
    names = [f.split()[0] for f in schema.split(", ")]

    def far(vectors: np.ndarray) -> np.ndarray:
        return (cells[0] * cells[0]).sum(axis=1)[None, :] - 2 * vectors @ cells[0].T

    def close(rough: np.ndarray, off: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """What may be among the k nearest: not surely beyond the limit, nor beyond the k-th of this block. What has no order stays."""
        mask = ~(rough > (limit + SLACK * np.abs(limit) + 2 * off)[:, None])
        many = np.flatnonzero(mask.sum(axis=1) > max(2 * k, 32)) if rough.shape[1] > k else []
        if len(many):
            last = np.partition(rough[many], k - 1, axis=1)[:, k - 1]
            mask[many] &= ~(rough[many] > (last + SLACK * np.abs(last) + 2 * off[many])[:, None])
        return mask

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        middle, width = _middle(matrix, metric), matrix.shape[1]
        pairs = max(1, (EXACT_MB << 20) // (8 * max(1, width)))
        nearest: dict[tuple, np.ndarray] = {}  # by group, each query's k least distances so far, while they are few
        room = (BOUND_MB << 20) // (8 * k * len(ids))
        if cells:
            open_ = np.zeros((len(ids), len(cells[0])), bool)
            for lo in range(0, len(ids), 1024):
                near = np.argsort(far(matrix[lo : lo + 1024]), axis=1, kind="stable")[:, : cells[1]]
                np.put_along_axis(open_[lo : lo + 1024], near, True, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            vectors = b.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if vectors.null_count or len(flat) != len(own) * width or (np.diff(vectors.offsets.to_numpy()) != width).any():
                raise ValueError("vector dimension mismatch")
            block = flat.reshape(len(own), -1)
            groups = {(): np.arange(len(own))}
            if per:
                keys = b.select([2 + columns.index(c) for c in per]).to_pandas().groupby(list(per), dropna=False, sort=False).indices
                groups = {key: np.sort(g) for key, g in keys.items()}
            cell = far(block).argmin(axis=1) if cells else None
            before = [pc.rank(b.column(2 + columns.index(c)), null_placement="at_start", tiebreaker="dense").to_numpy() for c in reversed(ranks or [])]

            def rows(parts: list) -> pa.RecordBatch:
                who, at, value = map(np.concatenate, zip(*parts, strict=True))
                take = pa.array(at)
                return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(own[at]), pa.array(value), *[b.column(2 + j).take(take) for j in range(len(columns))]], names=names)

            held, count = [], 0
            for key, g in groups.items():
                if key not in nearest and len(nearest) < room:
                    nearest[key] = np.full((len(ids), k), np.inf)
                best = nearest.get(key)
                moved = block[g] - middle
                step = max(1, CELLS // len(g))
                for lo in range(0, len(ids), step):
                    rough, off = _rough(matrix[lo : lo + step] - middle, moved, middle, metric)
                    limit = np.full(len(rough), np.inf) if best is None else best[lo : lo + step].max(axis=1)
                    asks = np.ones(rough.shape, bool) if exclude_self or cells else None
                    if exclude_self:
                        asks &= ids[lo : lo + step, None] != own[None, g]
                    if cells:
                        asks &= open_[lo : lo + step][:, cell[g]]
                    if asks is not None:
                        rough[~asks] = np.inf
                    mask = close(rough, off, limit * limit if metric == "l2" else limit)
                    if asks is not None:
                        mask &= asks
                    who, at = np.nonzero(mask)
                    who, at = who + lo, g[at]
                    value = np.empty(len(who))
                    for i in range(0, len(who), pairs):
                        value[i : i + pairs] = _exact(matrix[who[i : i + pairs]], block[at[i : i + pairs]], metric)
                    if ranks is not None and len(who) > k:
                        who, at, value = _first(who, at, value, own, before, k)
                    if best is not None:
                        _merge(best, who, value)
                    for i in range(0, len(who), OUT_ROWS):
                        held.append((who[i : i + OUT_ROWS], at[i : i + OUT_ROWS], value[i : i + OUT_ROWS]))
                        count += len(held[-1][0])
                        if count >= OUT_ROWS:
                            yield rows(held)
                            held, count = [], 0
            if held:
                yield rows(held)

    return corpus.select(F.col(id_col).cast("long"), vector_col, *columns).mapInArrow(work, schema)


def _first(who: np.ndarray, at: np.ndarray, value: np.ndarray, own: np.ndarray, before: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's first k pairs by distance, the columns before the id, and the id; ``who`` ascends."""
    count = np.bincount(who - who[0]) if len(who) else np.zeros(1, int)
    if count.max() <= k:
        return who, at, value
    order = np.lexsort((own[at], *[c[at] for c in before], value, who))
    place = np.arange(len(who)) - (np.cumsum(count) - count)[who - who[0]]
    order = order[place < k]
    return who[order], at[order], value[order]


def _merge(best: np.ndarray, who: np.ndarray, value: np.ndarray) -> None:
    """Take distances into the queries' k least; ``who`` ascends."""
    if not len(who):
        return
    asked, start, count = np.unique(who, return_index=True, return_counts=True)
    new = np.full((len(asked), best.shape[1]), np.inf)
    place = np.arange(len(who)) - np.repeat(start, count)
    fits = place < best.shape[1]  # any k of more are an upper bound
    new[np.repeat(np.arange(len(asked)), count)[fits], place[fits]] = value[fits]
    both = np.concatenate((best[asked], new), axis=1)
    best[asked] = np.partition(both, best.shape[1] - 1, axis=1)[:, : best.shape[1]]
