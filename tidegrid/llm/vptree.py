"""Approximate nearest neighbours: vantage-point trees per shard.

Vectors are scaled to length one; the distance between two is their chord,
``sqrt(2 - 2 cos)``, a metric that orders as the cosine does. Vectors are
dealt to shards by a hash of their id, so copies of one vector spread evenly.
Each shard is one tree, built once and kept as a row of the index. A node
splits its vectors at the median distance from a vantage point; a search
leaves out a side when the triangle inequality puts all of it further than
``factor`` times the k-th distance found so far. A factor of one is exact;
below one more is left out.

Queries come in blocks and meet every shard: a task reads a tree once and the
blocks stream past it. Each (block, shard) gives its k best, merged per query.
Equal cosines go to the smaller id. Scores are computed in double precision on
the vectors as given; where more candidates than a few tie up to rounding,
these scores decide inside the tree as well.

Vectors that are null, empty, all zero or hold null or non-finite components
take no part, neither do rows without an id nor, per search, candidates of
another dimension than the query's. Rows that repeat an id and vector are
separate candidates; a query leaves out all candidates of its own id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, maybe_broadcast, table

SHARD, QUERIES, LEAF, TIES = 8192, 512, 128, 64
SLACK = 1e-9  # of squared chords, for rounding: never prunes or drops a tie


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id is not null and size(vector) > 0")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(good)


class Tree:
    """A vantage-point tree; rows are reordered so that every leaf is a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (vantage, children: (node or slice, least and greatest distance))
        self.root = self._build(order, 0)
        self.ids, self.vectors, self.unit = ids[order], vectors[order], self.unit[order]

    def _build(self, order: np.ndarray, at: int):
        if len(order) <= LEAF:
            return (at, at + len(order))
        vantage = self.unit[order[int(np.argmax(1 - self.unit[order] @ self.unit[order[0]]))]]  # the one furthest from the first
        chord = np.sqrt(np.maximum(0, 2 - 2 * (self.unit[order] @ vantage)))
        rank = np.argsort(chord, kind="stable")
        order[:] = order[rank]
        chord = chord[rank]
        half = len(order) // 2
        node = len(self.nodes)
        self.nodes.append(())
        sides = []
        for lo, hi in ((0, half), (half, len(order))):
            bounds = chord[lo], chord[hi - 1]
            sides.append((self._build(order[lo:hi], at + lo), *bounds))
        self.nodes[node] = (vantage, *sides)
        return node

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """Per query the row numbers of the k nearest, and of others that tie with the last up to rounding."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        found = [np.zeros(0, np.int64) for _ in ids]
        cosines = [np.zeros(0) for _ in ids]
        worst = np.full(len(ids), np.inf)  # the k-th chord so far

        def visit(node, who: np.ndarray) -> None:
            if isinstance(node, tuple):
                a, b = node
                cos = unit[who] @ self.unit[a:b].T
                cos[ids[who][:, None] == self.ids[None, a:b]] = -np.inf
                open_ = cos >= (1 - worst[who] ** 2 / 2)[:, None] - SLACK
                for r in np.flatnonzero(open_.any(axis=1)):
                    q = who[r]
                    new = np.flatnonzero(open_[r] & (cos[r] > -np.inf))
                    rows, c = np.concatenate((found[q], new + a)), np.concatenate((cosines[q], cos[r, new]))
                    if len(c) > k:
                        last = np.partition(c, len(c) - k)[len(c) - k]
                        keep = c >= last - SLACK
                        rows, c = rows[keep], c[keep]
                        if len(c) > k + TIES:  # decided as the final ranking does it
                            score = cosine(np.broadcast_to(queries[q], (len(rows), queries.shape[1])), self.vectors[rows])
                            top = np.lexsort((self.ids[rows], -score))[:k]
                            rows, c = rows[top], c[top]
                    found[q], cosines[q] = rows, c
                    if len(c) >= k:
                        worst[q] = np.sqrt(max(0.0, 2 - 2 * np.partition(c, len(c) - k)[len(c) - k]))
                return
            vantage, near, far = self.nodes[node]
            chord = np.sqrt(np.maximum(0, 2 - 2 * (unit[who] @ vantage)))
            inner = chord - near[2] <= far[1] - chord  # nearer to the inner side
            for mine, first, second in ((inner, near, far), (~inner, far, near)):
                for side in (first, second):
                    own, c = who[mine], chord[mine]
                    gap = np.maximum(side[1] - c, c - side[2])  # at least so far is every vector of the side
                    left = gap <= factor * worst[own] + 1e-7
                    if left.any():
                        visit(side[0], own[left])

        if len(self.ids) and len(ids):
            visit(self.root, np.arange(len(ids)))
        return found


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, adding from the first component to the last."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, shard_rows: int = SHARD) -> DataFrame:
    """shard, dimension, tree: one row per shard of about shard_rows vectors and dimension."""
    bounded_batches(vectors.sparkSession)
    rows = materialize(valid(vectors, id_col, vector_col), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), F.size("vector").cast("long").alias("dimension"), "id", "vector")

    def build(key, part):
        ids = part.column("id").to_numpy()
        flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        tree = Tree(ids, flat.reshape(len(ids), -1).astype(np.float64))
        return pa.table({"shard": [key[0].as_py()], "dimension": [key[1].as_py()], "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    made = dealt.groupBy("shard", "dimension").applyInArrow(build, "shard long, dimension long, tree binary")
    return materialize(made, "index")


def search(index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, factor: float = 1.0, block_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest to each query, its own id left out."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    bounded_batches(queries.sparkSession)
    rows = materialize(valid(queries, id_col, vector_col), "queries")
    blocks = max(1, -(-rows.count() // block_rows))
    packed = (
        rows.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).alias("block"), F.size("vector").cast("long").alias("dimension"), "id", "vector")
        .groupBy("block", "dimension")
        .agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    )
    spark = queries.sparkSession
    shards = index.select("shard", "dimension")
    # with few trees each goes to several tasks
    slices = min(blocks, max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, shards.count()))))
    none = F.lit(None)
    trees = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("shard", "dimension", "slice", F.lit(-1).cast("long").alias("block"), "tree", none.cast("array<struct<id:long,vector:array<double>>>").alias("queries"))
    asked = packed.join(maybe_broadcast(shards, 16), "dimension").select("shard", "dimension", F.pmod("block", F.lit(slices)).cast("int").alias("slice"), "block", none.cast("binary").alias("tree"), "queries")
    key = ["shard", "dimension", "slice"]
    work = trees.union(asked).repartition(*key).sortWithinPartitions(*key, "block")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            for qs, blob in zip(b.column("queries"), b.column("tree"), strict=True):
                if blob.is_valid:
                    tree = pickle.loads(blob.as_buffer())
                    continue
                s = qs.values
                ids = s.field("id").to_numpy()
                vectors = s.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                hits = tree.search(ids, vectors, k, factor)
                who = np.repeat(np.arange(len(ids)), [len(h) for h in hits])
                at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                score = cosine(vectors[who], tree.vectors[at])
                best = np.lexsort((tree.ids[at], -score, who))
                who, at, score = who[best], at[best], score[best]
                first = np.searchsorted(who, who)
                keep = np.arange(len(who)) - first < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[who[keep]]), pa.array(tree.ids[at[keep]]), pa.array(score[keep])], ["query_id", "vec_id", "score"]
                )

    hits = work.select("queries", "tree").mapInArrow(find, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    index = build_index(vectors, "vec_id", "embedding")
    return search(index, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) / (q.l * c.l) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
