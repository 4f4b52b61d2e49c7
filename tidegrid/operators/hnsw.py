"""Graph search: one small-world graph per time bucket, as a table of nodes.

A graph is built by one task per (bucket, shard) in the order of (ts, id), with
levels drawn from a hash of the id, so that a build is repeatable. A shard
bounds the nodes of a task; a search asks every shard of a bucket and merges.
A node that is added alone finds its candidates by a beam; when a whole shard
is built, they are the exact nearest of the nodes before it, found block by
block with matrix products. A built graph's lowest level is connected, so that
a beam as wide as the graph meets every node.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..types import CollectionConfig
from .knn import CELLS, QUERY_MB, SLACK, _exact, _first, _middle, _rough, query_chunks, top_k

MAX_LEVEL, BEAM, BEAM_LEVELS, PENALTY = 32, 5, 3, 0.8
SHARD_ROWS = 20_000


def _l2sq(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.einsum("ij,ij->i", gap, gap)


def _cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    both = np.sqrt(np.einsum("ij,ij->i", rows, rows) * (query @ query))
    return np.where(both == 0, 1.0, 1.0 - rows @ query / np.where(both == 0, 1.0, both))


#: What a graph's edges are measured by.
GAPS = {"l2sq": _l2sq, "cosine": _cosine, "neg_dot": lambda rows, query: -(rows @ query)}


class Graph:
    """Nodes in insertion order; ``edges[node][level]`` are neighbour lists of bounded length."""

    def __init__(self, config: CollectionConfig, metric: str = "l2sq") -> None:
        if metric not in GAPS:
            raise InvalidArgument(f"no graph by {metric!r}; known: {', '.join(GAPS)}")
        self.config, self.metric, self.gap = config, metric, GAPS[metric]
        self.vectors = np.zeros((16, config.dim))
        self.edges: list[list[list[int]]] = []
        self._gaps: dict[tuple[int, int], list[float]] = {}  # by node and level, the lengths of the edges of full lists
        self.entry: int | None = None

    def __len__(self) -> int:
        return len(self.edges)

    def cap(self, level: int) -> int:
        return self.config.m_max0 if level == 0 else self.config.m

    def distances(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        return self.gap(self.vectors[nodes], query)

    def descend(self, query: np.ndarray, node: int, level: int) -> int:
        """The local minimum reached from a node by always going to the closest neighbour."""
        best = float(self.distances(query, [node])[0])
        while near := self.edges[node][level]:
            found = self.distances(query, near)
            k = int(found.argmin())
            if found[k] >= best:
                break
            node, best = near[k], float(found[k])
        return node

    def beam(self, query: np.ndarray, start: list[int], level: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` closest nodes met, nearest first."""
        first = [(float(d), n) for d, n in zip(self.distances(query, start), start, strict=True)]
        seen, open_, kept = set(start), list(first), [(-d, n) for d, n in first]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while open_:
            d, node = heapq.heappop(open_)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = [n for n in self.edges[node][level] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, n in zip(self.distances(query, fresh).tolist(), fresh, strict=True):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(open_, (e, n))
                    heapq.heappush(kept, (-e, n))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted((-d, n) for d, n in kept)

    def add(self, vector: np.ndarray, level: int) -> int:
        node, c = len(self.edges), self.config
        if node == len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        self.vectors[node] = vector
        self.edges.append([[] for _ in range(level + 1)])
        if self.entry is None:
            self.entry = node
            return node
        at = self.entry
        top = len(self.edges[at]) - 1
        for lv in range(top, level, -1):
            at = self.descend(vector, at, lv)
        start = [at]
        for lv in range(min(top, level), -1, -1):
            found = self.beam(vector, start, lv, c.ef_construction)
            start = [n for _, n in found]
            self.attach(node, lv, found)
        if level > top:
            self.entry = node
        return node

    def attach(self, node: int, level: int, found: list[tuple[float, int]]) -> None:
        """Link a node with the best of its candidates, of which those with many edges count as farther."""
        cap = self.cap(level)
        score = [(d * (1 + PENALTY * len(self.edges[n][level]) / cap), n, d) for d, n in found if n != node]
        for _, n, d in sorted(score)[:cap]:
            if self.link(n, node, level, d):  # a neighbour that refuses the way back gets none
                self.link(node, n, level, d)

    def fill(self, vectors: np.ndarray, levels: np.ndarray) -> None:
        """Make the graph of these nodes, in their order; levels are filled one after another, as none depends on another's edges."""
        self.vectors, self.edges = vectors, [[[] for _ in range(lv + 1)] for lv in levels.tolist()]
        self.entry = int(levels.argmax()) if len(levels) else None
        for lv in range(int(levels.max(initial=-1)) + 1):
            members = np.flatnonzero(levels >= lv)
            for place, gaps, near in nearest_before(vectors[members], self.config.ef_construction, self.metric):
                self.attach(int(members[place]), lv, list(zip(gaps.tolist(), members[near].tolist(), strict=True)))
        self.connect()

    def component(self, start: int) -> dict[int, int]:
        """What is reached from a node on the lowest level, with the node that each was first met from."""
        met, open_ = {start: start}, [start]
        while open_:
            at = open_.pop()
            for n in self.edges[at][0]:
                if n not in met:
                    met[n] = at
                    open_.append(n)
        return met

    def components(self) -> list[dict[int, int]]:
        """All of them, the largest first."""
        found, seen = [], set()
        for node in range(len(self)):
            if node not in seen:
                found.append(self.component(node))
                seen.update(found[-1])
        return sorted(found, key=len, reverse=True)

    def connect(self) -> None:
        """Tie every component of the lowest level to the rest by its shortest edge between nodes with room; lists stay within their bound."""
        first, *others = self.components() or [{}]
        inside = list(first)
        for part in others:
            a, b = self.roomy(list(part)), self.roomy(inside)
            best = (np.inf, a[0], b[0])
            for n in a:
                gaps = self.distances(self.vectors[n], b)
                k = int(gaps.argmin())
                best = min(best, (float(gaps[k]), n, b[k]))
            self.edges[best[1]][0].append(best[2])
            self.edges[best[2]][0].append(best[1])
            inside += part
        self._gaps.clear()

    def roomy(self, nodes: list[int]) -> list[int]:
        """The nodes of a component with room for an edge; where all are full, an edge that closes a circle is given up."""
        room = [n for n in nodes if len(self.edges[n][0]) < self.cap(0)]
        if room:
            return room
        met = self.component(nodes[0])
        a, b = next((a, b) for a in nodes for b in self.edges[a][0] if met[a] != b and met[b] != a)
        self.edges[a][0].remove(b)
        self.edges[b][0].remove(a)
        return [a, b]

    def link(self, a: int, b: int, level: int, gap: float | None = None) -> bool:
        """The edge a -> b (of length ``gap``); a full list gives up its farthest neighbour for a nearer one, both ways."""
        near = self.edges[a][level]
        if b in near:
            return True
        if len(near) < self.cap(level):
            self._gaps.pop((a, level), None)
            near.append(b)
            return True
        gaps = self._gaps.get((a, level))
        if gaps is None:
            gaps = self._gaps[a, level] = self.distances(self.vectors[a], near).tolist()
        most = max(gaps)
        gap = float(self.distances(self.vectors[a], [b])[0]) if gap is None else gap
        if gap >= most:
            return False
        far = gaps.index(most)
        gone, near[far], gaps[far] = near[far], b, gap
        back = self.edges[gone][level]
        if a in back:
            back.remove(a)
            self._gaps.pop((gone, level), None)
        return True

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry is None:
            return []
        at = self.entry
        top = len(self.edges[at]) - 1
        for lv in range(top, BEAM_LEVELS, -1):
            at = self.descend(query, at, lv)
        start = [at]
        for lv in range(min(top, BEAM_LEVELS), 0, -1):
            start = [n for _, n in self.beam(query, start, lv, BEAM)]
        return self.beam(query, start, 0, max(ef, k))[:k]

    def search_wide(self, queries: np.ndarray, k: int, within: float = 0.0):
        """Per query what a beam over all nodes keeps: the k nearest of the component that its search comes to, and all that are at most ``within`` farther.

        Yields query numbers and nodes. Distances are a block's at a time.
        """
        parts = [np.array(sorted(c)) for c in self.components()]
        home = np.zeros(len(queries), int)
        if len(parts) > 1:
            of = {int(n): i for i, c in enumerate(parts) for n in c}
            home = np.array([of[self.search(q, 1, 1)[0][1]] for q in queries])
        for i, part in enumerate(parts):
            asked = np.flatnonzero(home == i)
            middle = _middle(queries[asked], self.metric)
            moved = self.vectors[part] - middle
            step = max(1, CELLS // len(part))
            for lo in range(0, len(asked), step):
                rough, off = _rough(queries[asked[lo : lo + step]] - middle, moved, middle, self.metric)
                last = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(part) > k else np.full(len(rough), np.inf)
                who, at = np.nonzero(~(rough > (last + SLACK * np.abs(last) + 2 * off + within)[:, None]))
                yield asked[lo + who], part[at]


def nearest_before(vectors: np.ndarray, width: int, metric: str):
    """Per row its number, and gaps and numbers of the ``width`` nearest of the rows before it."""
    middle = _middle(vectors, metric)
    moved = vectors - middle
    lo = 0
    while lo < len(vectors):
        hi = min(len(vectors), lo + max(1, int(((lo * lo + 4 * CELLS) ** 0.5 - lo) / 2)))  # CELLS distances at most
        rough, _ = _rough(moved[lo:hi], moved[:hi], middle, metric)
        rough[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = np.inf
        near = np.argpartition(rough, width - 1, axis=1)[:, :width] if hi > width else np.broadcast_to(np.arange(hi), rough.shape)
        gaps = np.take_along_axis(rough, near, axis=1)
        if metric == "l2sq":
            np.maximum(gaps, 0, out=gaps)
        for i in range(hi - lo):
            fine = near[i] < lo + i
            yield lo + i, gaps[i][fine], near[i][fine]
        lo = hi


def level_of(vector_id: int, m: int) -> int:
    """A geometric level from a hash of the id, the same on every machine."""
    x = (vector_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (1 << 64) - 1
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    x ^= x >> 32
    u = ((x >> 11) + 1) / ((1 << 53) + 1)
    return min(MAX_LEVEL, int(-math.log(u) / math.log(m)))


NODES = "bucket_seq int, bucket_start long, shard int, node_id int, vector_id long, level int, vector array<double>, neighbors array<array<int>>"


def build(stored: DataFrame, config: CollectionConfig, shard_rows: int = SHARD_ROWS, metric: str = "l2sq") -> DataFrame:
    """The graphs of stored(bucket_seq, bucket_start, ts, vector_id, vector), a row per node."""
    counts = stored.groupBy("bucket_seq").count().select("bucket_seq", F.ceil(F.col("count") / shard_rows).cast("int").alias("_shards"))
    graphs = counts.agg(F.sum("_shards")).first()[0] or 1
    rows = stored.select("bucket_seq", "bucket_start", "ts", "vector_id", "vector").join(F.broadcast(counts), "bucket_seq")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vector_id"), F.col("_shards")).cast("int")).drop("_shards")

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "vector_id"], kind="stable")
        graph = Graph(config, metric)
        levels = np.array([level_of(int(i), config.m) for i in part["vector_id"]])
        graph.fill(np.stack(part["vector"].to_numpy()).astype(np.float64), levels)
        out = part[["bucket_seq", "bucket_start", "shard", "vector_id"]].reset_index(drop=True)
        out["node_id"] = range(len(out))
        out["level"] = levels
        out["vector"] = list(graph.vectors)
        out["neighbors"] = graph.edges
        return out[[c.split()[0] for c in NODES.split(", ")]]

    # as many partitions as leave most graphs one of their own; small ones would be put together otherwise
    return rows.repartition(4 * graphs, "bucket_seq", "shard").groupBy("bucket_seq", "shard").applyInPandas(make, NODES)


def search(
    nodes: DataFrame, queries: DataFrame, config: CollectionConfig, k: int, ef: int = 100, recency=None, metric: str = "l2sq", digits: int | None = None
) -> DataFrame:
    """query_id, rank, vector_id, distance, bucket_seq: approximate hits over all graphs in nodes.

    Every bucket gives its k best by plain distance; ``recency`` (of bucket
    start and distance) adjusts them before the last cut. ``digits``: distances
    are rounded to so many before any cut, half away from zero.
    queries(query_id, query) go to every task in chunks of bounded size.
    """
    rows = queries.select(F.col("query_id").cast("long"), "query")
    chunk = max(1, (QUERY_MB << 20) // (8 * config.dim))
    schema = "query_id long, vector_id long, distance double, bucket_seq int, bucket_start long"
    hits = nodes.sparkSession.createDataFrame([], schema)
    for held in query_chunks(rows, "query_id", rows.count(), chunk):
        hits = hits.union(_ask(nodes, held, config, k, ef, metric, schema, digits))
    if recency:
        hits = top_k(hits, k, ["query_id", "bucket_seq"], ["distance", "vector_id"]).withColumn("distance", recency(F.col("bucket_start"), F.col("distance")))
    ranked = top_k(hits.drop("rank"), k, ["query_id"], ["distance", "bucket_seq", "vector_id"])
    return ranked.select("query_id", "rank", "vector_id", "distance", "bucket_seq")


def _ask(nodes: DataFrame, held: pd.DataFrame, config: CollectionConfig, k: int, ef: int, metric: str, schema: str, digits: int | None) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(), np.array(held["query"].tolist(), np.float64).reshape(len(held), -1)))

    def rounded(value: np.ndarray) -> np.ndarray:
        if digits is None:
            return value
        whole = np.trunc(value * 10.0**digits)
        rest = value * 10.0**digits - whole
        return (whole + np.where(np.abs(rest) >= 0.5, np.sign(rest), 0)) / 10.0**digits

    def find(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_id")
        graph = Graph(config, metric)
        graph.vectors = np.stack(part["vector"].to_numpy()).astype(np.float64)
        graph.edges = [[list(map(int, lv)) for lv in e] for e in part["neighbors"]]
        graph.entry = int(part["level"].to_numpy().argmax())
        asked, queries = shared.value
        ids, made = part["vector_id"].to_numpy(), []
        if max(ef, k) >= len(graph):
            found = graph.search_wide(queries, k, 0.0 if digits is None else 10.0**-digits)
        else:
            beams = [[n for _, n in graph.search(q, k, ef)] for q in queries]
            found = [(np.repeat(np.arange(len(beams)), [len(b) for b in beams]), np.array([n for b in beams for n in b], int))]
        for who, at in found:
            value = np.empty(len(who))
            for i in range(0, len(who), 1 << 13):
                value[i : i + (1 << 13)] = _exact(queries[who[i : i + (1 << 13)]], graph.vectors[at[i : i + (1 << 13)]], metric)
            value = rounded(value)
            who, at, value = _first(who, at, value, ids, [], k)
            made.append(pd.DataFrame({"query_id": asked[who], "vector_id": ids[at], "distance": value}))
        hits = pd.concat(made)
        hits["bucket_seq"], hits["bucket_start"] = key[0], int(part["bucket_start"].iloc[0])
        return hits

    return nodes.groupBy("bucket_seq", "shard").applyInPandas(find, schema)


def level_histogram(nodes: DataFrame) -> DataFrame:
    """level, n: how many nodes have that level as their highest."""
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def describe(nodes: DataFrame) -> DataFrame:
    """bucket_seq, shard, nodes, dim, top_level, entry: the size of every graph and the node that a search starts from."""
    first = F.min_by("vector_id", F.struct(F.negative("level"), "node_id"))
    return nodes.groupBy("bucket_seq", "shard").agg(F.count("*").alias("nodes"), F.max(F.size("vector")).alias("dim"), F.max("level").alias("top_level"), first.alias("entry"))


def describe_buckets(nodes: DataFrame) -> DataFrame:
    """As ``describe``, a bucket's shards taken together as shard 0: of their entries the highest, then the one of the least id."""
    first = F.min_by("entry", F.struct(F.negative("top_level"), "entry"))
    made = [F.sum("nodes").alias("nodes"), F.max("dim").alias("dim"), F.max("top_level").alias("top_level"), first.alias("entry")]
    return describe(nodes).groupBy("bucket_seq").agg(F.lit(0).alias("shard"), *made)


def edges(nodes: DataFrame) -> DataFrame:
    """bucket_seq, node_id, level, neighbors: the graphs as an edge table."""
    return nodes.select("bucket_seq", "shard", "node_id", F.posexplode("neighbors").alias("level", "neighbors"))
