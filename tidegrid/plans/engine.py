"""Collections of time-bucketed vectors: ingest, search, tiers, snapshots, recovery.

A collection is a folder of immutable Parquet files and one manifest, a
document of numbered versions (see ``files``). It names the files of every
bucket; each change makes a new version from the newest one, or starts over if
another writer came between:

    <root>/<collection>/manifest/v<n>.json
    <root>/<collection>/data/<entry>/part=<s>/*.parquet     rows, written once
    <root>/<collection>/wal/<entry>/v1.json                 marks an entry that no snapshot covers yet
    <blob>/<collection>/collection/, gone/, seq_<s>/bucket_meta/, seq_<s>/snap_<t>/*.parquet
    <blob>/catalog/

The log is the data itself: an entry's rows carry the bucket that they were
dealt to, and its marker goes once every live bucket has a snapshot that holds
all rows of that time. Recovery reads the newest snapshots and what the
remaining markers name, puts rows where they were, and commits one manifest at
the end; it can be cut off at any point and started again.

The manifest holds a line per bucket and entry, no rows. Known ids are the
rows themselves and the ids of dropped buckets, which stay known, also to a
recovery elsewhere. Buckets in the blob tier and evicted ones are sealed: rows
for them open another bucket of the same start.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Aborted, AlreadyExists, FailedPrecondition, Internal, InvalidArgument, NotFound
from ..functions.buckets import in_range, slot_of
from ..operators import buckets as B
from ..operators import hnsw
from ..operators import ingest as I
from ..operators.knn import knn_batch
from ..shipping import ship
from ..sources import wal
from ..types import STORED, CollectionConfig
from .files import Files

HOT, DISK, EVICTED, BLOB = "hot", "disk", "evicted", "blob"
FORMAT, TRIES = 1, 20
ID_MB = 64  # ids of a batch that are broadcast to the scan of the known ones
SEQ, ENTRY = re.compile(r"seq_([0-9]+)"), re.compile(r"([0-9]{12})-[0-9a-f]{8}")


class Engine:
    def __init__(self, spark: SparkSession, root: str, blob: str | None = None) -> None:
        self.spark, self.root, self.blob = spark, root.rstrip("/"), blob.rstrip("/") if blob else None
        self.files = Files(spark)
        ship(spark)
        self._cached: dict[tuple[str, int], DataFrame] = {}

    # collections

    def create_collection(self, name: str, config: CollectionConfig) -> None:
        if not name or not re.fullmatch(r"[A-Za-z0-9._-]+", name):
            raise InvalidArgument("a collection needs a name of letters, digits, '.', '_' and '-'")
        config.validated()
        try:
            self.files.write_json(self._manifest(name), self._fresh(config.to_dict()), after=0)
        except Aborted as e:
            raise AlreadyExists(f"collection {name} exists") from e
        if self.blob:
            self._write_meta(name)
            self._write_catalog()

    @staticmethod
    def _fresh(config: dict) -> dict:
        return {"version": FORMAT, "config": config, "entries": 0, "inserts": 0, "next_seq": 0, "buckets": {}, "gone_ids": [], "log_from": 0}

    def has_collection(self, name: str) -> bool:
        return self.files.version(self._manifest(name)) > 0

    def collections(self) -> list[str]:
        return [n for n in self.files.list(self.root) if self.has_collection(n)]

    def config(self, name: str) -> CollectionConfig:
        return CollectionConfig(**self._get(name)["config"])

    def drop_collection(self, name: str) -> None:
        """Delete a collection, its snapshots and its log."""
        state = self._get(name)
        for b in state["buckets"].values():
            self._forget(name, b["seq"])
        if self.blob:
            self._write_catalog(without=name)
            self.files.delete(f"{self.blob}/{name}")
        self.files.delete(f"{self.root}/{name}")

    def reset_collection(self, name: str) -> None:
        """Empty a collection: no rows, buckets or known ids; the configuration stays and numbers go on."""

        def change(state: dict) -> list[int]:
            seqs = [b["seq"] for b in state["buckets"].values()]
            state.update(buckets={}, gone_ids=[], log_from=state["entries"], inserts=state["inserts"] + 1)
            state.pop("graph", None)
            return seqs

        seqs = self._update(name, change)
        if self.blob:
            self._write_meta(name)
            for seq in seqs:
                self._bury(name, seq)
        for seq in seqs:
            self._forget(name, seq)
        self._prune(name)

    def _manifest(self, name: str) -> str:
        return f"{self.root}/{name}/manifest"

    def _read(self, name: str) -> tuple[dict, int]:
        found, version = self.files.read_version(self._manifest(name)) if name else (None, 0)
        if found is None:
            raise NotFound(f"no collection {name}")
        if found.get("version") != FORMAT:
            raise Internal(f"the manifest of {name} has the unknown format {found.get('version')}")
        return found, version

    def _get(self, name: str) -> dict:
        return self._read(name)[0]

    def _update(self, name: str, change):
        """change(state) on the newest state, again while other writers come between; its result. A state left as it was is not written."""
        for _ in range(TRIES):
            state, version = self._read(name)
            before = json.dumps(state, sort_keys=True)
            result = change(state)
            if json.dumps(state, sort_keys=True) == before:
                return result
            try:
                self.files.write_json(self._manifest(name), state, version)
                return result
            except Aborted:
                continue
        raise Aborted(f"{name} is changed by too many writers")

    # ingest

    def batch_insert(self, name: str, rows: DataFrame, mode: str = "arrival") -> DataFrame:
        """bucket_seq, vector_id of the rows taken. rows(vector_id, ts, vector[, arrival]); the batch is taken whole or not at all."""
        none = self.spark.createDataFrame([], "bucket_seq int, vector_id long")
        if rows.isEmpty():
            return none
        config = self.config(name)
        arrival = F.col("arrival") if "arrival" in rows.columns else F.monotonically_increasing_id().alias("arrival")
        staging = f"{self.root}/{name}/staging/{uuid.uuid4().hex}"
        rows.select(F.col("vector_id").cast("long"), F.col("ts").cast("long"), F.col("vector").cast("array<float>"), arrival).write.parquet(staging)
        try:
            staged = self.spark.read.parquet(staging)
            span = I.validate(staged, config.dim)
            for _ in range(TRIES):
                state, version = self._read(name)
                newest = max(state["buckets"].values(), key=lambda b: b["seq"], default=None)
                taken = I.accepted(staged, self._known(state, staged, span))
                routed = B.assign(taken, config.duration, mode, newest=newest["start"] if newest and mode == "arrival" else None)
                entry = f"{state['entries']:012d}-{uuid.uuid4().hex[:8]}"
                written = self._place(name, state, routed, entry)
                if written is None:
                    return none
                if self._commit(name, state, version, entry, {"kind": "insert"}):
                    return written.select("bucket_seq", "vector_id")
                self.files.delete(f"{self.root}/{name}/data/{entry}")
        finally:
            self.files.delete(staging)
        raise Aborted(f"{name} is changed by too many writers")

    def replay_log(self, name: str, folder: str, after: int = -1) -> DataFrame:
        """Insert the entries of a folder of binary log files behind a sequence number, in their order; bucket_seq, vector_id of the rows taken."""
        rows = wal.read(self.spark, folder, after)
        return self.batch_insert(name, rows.select("vector_id", "ts", "vector", F.expr("seq * 4294967296 + position").alias("arrival")))

    def _place(self, name: str, state: dict, routed: DataFrame, entry: str) -> DataFrame | None:
        """Write routed rows by bucket and enter them in state; None if there are none. Rows with a bucket_seq go there if its start agrees."""
        given = "bucket_seq" in routed.columns
        routed = routed if given else routed.withColumn("bucket_seq", F.lit(None).cast("int"))
        wanted = sorted(map(tuple, routed.select("bucket_start", "bucket_seq").distinct().collect()), key=lambda w: (w[0], w[1] or 0))  # a row per bucket
        if not wanted:
            return None
        numbers = [(start, seq, self._seat(state, start, seq)) for start, seq in wanted]
        numbers = self.spark.createDataFrame(numbers, "_start long, _seq int, seq int")
        data = f"{self.root}/{name}/data/{entry}"
        placed = routed.join(F.broadcast(numbers), (F.col("bucket_start") == F.col("_start")) & F.col("bucket_seq").eqNullSafe(F.col("_seq")))
        placed = placed.select("vector_id", "ts", "vector", F.col("seq").alias("bucket_seq"), "bucket_start", F.col("seq").alias("part"))
        placed.write.mode("overwrite").partitionBy("part").parquet(data)
        written = self.spark.read.schema(STORED).parquet(data)
        for seq, n in written.groupBy("bucket_seq").count().collect():
            b = state["buckets"][str(seq)]
            b["files"].append(f"{data}/part={seq}")
            b["rows"] += n
        return written

    @staticmethod
    def _seat(state: dict, start: int, seq: int | None) -> int:
        """The number of the bucket that takes rows of a start, opened if there is none."""
        own = state["buckets"].get(str(seq))
        if own is not None and own["start"] == start:
            return seq
        if seq is None or own is not None:
            open_ = [b["seq"] for b in state["buckets"].values() if b["start"] == start and b["tier"] not in (BLOB, EVICTED)]
            if open_:
                return max(open_)  # of several with one start the newest takes rows
            seq = state["next_seq"]
        state["buckets"][str(seq)] = {"seq": seq, "start": start, "tier": HOT, "files": [], "rows": 0, "clean": 0, "snap": None}
        state["next_seq"] = max(state["next_seq"], seq + 1)
        return seq

    def _commit(self, name: str, state: dict, version: int, entry: str, mark: dict) -> bool:
        """Mark the entry in the log, then make the state the newest; False, and nothing is left, if another writer was faster."""
        marker = f"{self.root}/{name}/wal/{entry}"
        self.files.write_json(marker, mark, after=0)
        state["entries"] += 1
        state["inserts"] += mark["kind"] == "insert"
        try:
            self.files.write_json(self._manifest(name), state, version)
        except Aborted:
            self.files.delete(marker)
            return False
        for n, seq in list(self._cached):
            if n == name and any(entry in f for f in state["buckets"][str(seq)]["files"]):
                self._forget(name, seq)
        return True

    def _known(self, state: dict, batch: DataFrame, span: tuple) -> DataFrame | None:
        """The ids of a batch that the collection has: one column is scanned, between the batch's least and greatest id."""
        paths = [f for b in state["buckets"].values() for f in b["files"]] + state["gone_ids"]
        if not paths:
            return None
        rows = self.spark.read.schema("vector_id long").parquet(*paths).where(F.col("vector_id").between(span[1], span[2]))
        if span[0] * 16 <= ID_MB << 20:
            rows = rows.join(F.broadcast(batch.select("vector_id").distinct()), "vector_id", "left_semi")
        return rows

    def rotate_bucket(self, name: str, ts: int) -> int:
        """Open a bucket at the slot of ts; an empty newest one is stamped anew instead."""
        for _ in range(TRIES):
            state, version = self._read(name)
            start = slot_of(ts, CollectionConfig(**state["config"]).duration)
            newest = max(state["buckets"].values(), key=lambda b: b["seq"], default=None)
            if newest is not None and newest["rows"] == 0:
                newest["start"] = start
                seq = newest["seq"]
            else:
                seq = state["next_seq"]
                state["buckets"][str(seq)] = {"seq": seq, "start": start, "tier": HOT, "files": [], "rows": 0, "clean": 0, "snap": None}
                state["next_seq"] += 1
            entry = f"{state['entries']:012d}-{uuid.uuid4().hex[:8]}"
            if self._commit(name, state, version, entry, {"kind": "rotate", "seq": seq, "start": start}):
                return seq
        raise Aborted(f"{name} is changed by too many writers")

    # search

    def stored(self, name: str, start: int | None = None, end: int | None = None, strict: bool = False) -> DataFrame:
        """The rows of the buckets that overlap [start, end), found from the manifest: no other file is opened, and all are one scan."""
        state = self._get(name)
        d = CollectionConfig(**state["config"]).duration
        paths, held = [], []
        for b in state["buckets"].values():
            if start is not None and end is not None and (start >= end or not slot_of(start, d) <= b["start"] <= slot_of(end - 1, d)):
                continue
            if b["tier"] == EVICTED:
                if strict:
                    raise FailedPrecondition(f"bucket {b['seq']} is evicted")
                continue
            if (name, b["seq"]) in self._cached:
                held.append(self._cached[name, b["seq"]])
            else:
                paths += b["files"]
        rows = self.spark.read.schema(STORED).parquet(*paths) if paths else None
        for part in held:
            rows = part if rows is None else rows.unionByName(part)
        return rows if rows is not None else self.spark.createDataFrame([], STORED)

    def _forget(self, name: str, seq: int) -> None:
        if (held := self._cached.pop((name, seq), None)) is not None:
            held.unpersist()

    def search(
        self,
        name: str,
        queries: DataFrame | list[float],
        k: int,
        range_start: int | None = None,
        range_end: int | None = None,
        metric: str = "l2sq",
        recency=None,
        exact_time: bool = False,
        strict: bool = False,
    ) -> DataFrame:
        """query_id, rank, vector_id, distance, bucket_seq. A range needs both bounds; it selects whole buckets unless ``exact_time``."""
        if k < 1:
            raise InvalidArgument("k must be at least 1")
        if isinstance(queries, list):
            if not queries:
                raise InvalidArgument("the query is empty")
            queries = self.spark.createDataFrame([(0, [float(x) for x in queries])], "query_id long, query array<double>")
        if range_start is None or range_end is None:
            range_start = range_end = None
        dim = self.config(name).dim
        if not queries.where(F.size("query") != dim).isEmpty():
            raise InvalidArgument(f"a query is not of dimension {dim}")
        rows = self.stored(name, range_start, range_end, strict)
        if exact_time and range_start is not None:
            rows = rows.where((F.col("ts") >= range_start) & (F.col("ts") < range_end))
        adjust = recency(F.col("bucket_start"), F.col("distance")) if recency else None
        hits = knn_batch(rows, queries, k, metric, per=("bucket_seq",), keep=("bucket_seq", "bucket_start"), adjust=adjust, order=("bucket_seq",))
        return hits.select("query_id", "rank", "vector_id", "distance", "bucket_seq")

    # graphs

    def build_graphs(self, name: str) -> int:
        """Build a graph for every live bucket, for ``search_graph``; the number of nodes."""
        state = self._get(name)
        path = f"{self.root}/{name}/graph/{state['inserts']:012d}-{uuid.uuid4().hex[:8]}"
        hnsw.build(self.stored(name), CollectionConfig(**state["config"])).write.parquet(path)
        self._update(name, lambda now: now.update(graph={"path": path, "inserts": state["inserts"]}))
        return self.spark.read.parquet(path).count()

    def search_graph(
        self, name: str, queries: DataFrame, k: int, ef: int = 100, range_start: int | None = None, range_end: int | None = None, recency=None
    ) -> DataFrame:
        """As ``search``, approximately: the k best of every bucket's graph, then adjusted and merged. ``ef`` below k counts as k."""
        if k < 1:
            raise InvalidArgument("k must be at least 1")
        state = self._get(name)
        graph = state.get("graph")
        if graph is None or graph["inserts"] != state["inserts"]:
            raise FailedPrecondition("the graphs are not built or older than the last insert")
        config = CollectionConfig(**state["config"])
        if not queries.where(F.size("query") != config.dim).isEmpty():
            raise InvalidArgument(f"a query is not of dimension {config.dim}")
        live = [b["seq"] for b in state["buckets"].values() if b["tier"] != EVICTED]
        nodes = self.spark.read.schema(hnsw.NODES).parquet(graph["path"]).where(F.col("bucket_seq").isin(live))
        nodes = nodes.where(in_range("bucket_start", range_start, range_end, config.duration))
        hits = hnsw.search(nodes, queries, config, k, ef, recency)
        return hits.select("query_id", "rank", "vector_id", "distance", "bucket_seq")

    # counts

    def bucket_metas(self, name: str) -> list[dict]:
        return sorted(self._get(name)["buckets"].values(), key=lambda b: -b["seq"])

    def has_bucket(self, name: str, seq: int) -> bool:
        return str(seq) in self._get(name)["buckets"]

    def bucket_created_at(self, name: str, seq: int) -> int | None:
        b = self._get(name)["buckets"].get(str(seq))
        return b and b["start"]

    def bucket_tier(self, name: str, seq: int) -> str | None:
        """'hot', 'disk', 'evicted' or 'blob'."""
        b = self._get(name)["buckets"].get(str(seq))
        return b and b["tier"]

    def all_in_tier(self, name: str, *tiers: str) -> bool:
        """Whether there are buckets and all are in one of the tiers."""
        buckets = self._get(name)["buckets"].values()
        return bool(buckets) and all(b["tier"] in tiers for b in buckets)

    def count(self, name: str) -> int:
        return sum(b["rows"] for b in self._get(name)["buckets"].values())

    def is_empty(self, name: str) -> bool:
        return self.count(name) == 0

    def dirty(self, name: str) -> dict[int, int]:
        return {b["seq"]: b["rows"] - b["clean"] for b in self._get(name)["buckets"].values()}

    # tiers

    def swap_bucket_in(self, name: str, seq: int) -> bool:
        """Keep a bucket in memory (spilling to disk)."""

        def change(state: dict) -> dict | None:
            b = state["buckets"].get(str(seq))
            if b is not None and b["tier"] == EVICTED:
                raise FailedPrecondition(f"bucket {seq} is evicted")
            if b is not None and b["tier"] != BLOB:
                b["tier"] = HOT
            return b

        b = self._update(name, change)
        if b is None:
            return False
        if b["files"]:
            self._forget(name, seq)
            self._cached[name, seq] = self.spark.read.schema(STORED).parquet(*b["files"]).persist()
        return True

    def swap_bucket_out(self, name: str, seq: int) -> bool:
        """Leave a bucket to its files; it stays searchable."""

        def change(state: dict) -> bool:
            b = state["buckets"].get(str(seq))
            if b is not None and b["tier"] == HOT:
                b["tier"] = DISK
            return b is not None

        found = self._update(name, change)
        self._forget(name, seq)
        return found

    def evict_bucket(self, name: str, seq: int) -> tuple[bool, int]:
        """Take a bucket out of search; (found, its rows).

        With a blob store its rows are snapshotted if they are not, and the
        local files go; without one they stay, as there is no other copy.
        """
        return self._seal(name, seq, EVICTED)

    def swap_bucket_out_to_blob(self, name: str, seq: int, now: int | None = None) -> bool:
        """Leave a bucket to its snapshot, made if there is none of all its rows; it stays searchable and takes no more rows."""
        self._need_blob()
        return self._seal(name, seq, BLOB, now)[0]

    def _seal(self, name: str, seq: int, tier: str, now: int | None = None) -> tuple[bool, int]:
        for _ in range(TRIES):
            b = self._get(name)["buckets"].get(str(seq))
            if b is None or (tier == BLOB and b["tier"] in (BLOB, EVICTED)):
                return False, 0
            if self.blob and (b["rows"] > b["clean"] or b["snap"] is None) and not self.snapshot_bucket(name, seq, now):
                return False, 0

            def change(state: dict) -> list[str] | None:
                b = state["buckets"].get(str(seq))
                if b is None or (self.blob and b["rows"] > b["clean"]):
                    return None  # dropped, or rows came in between
                before = b["files"]
                if self.blob:
                    b["files"] = [b["snap"]] if b["snap"] else []
                b["tier"] = tier
                return [f for f in before if f not in b["files"]]

            local = self._update(name, change)
            if local is not None:
                self._forget(name, seq)
                for f in local:
                    if f.startswith(f"{self.root}/"):
                        self.files.delete(f)
                return True, b["rows"]
        raise Aborted(f"{name} is changed by too many writers")

    def swap_bucket_in_from_blob(self, name: str, seq: int) -> tuple[bool, int]:
        """Read a bucket back from its snapshot; (found, its rows). One with rows that the snapshot lacks is refused."""
        self._need_blob()
        meta = self.files.read_json(self._pointer(name, seq))

        def change(state: dict) -> int | None:
            b = state["buckets"].get(str(seq))
            if meta is None or meta.get("dropped") or b is None:
                return None
            if b["rows"] > meta["rows"]:
                raise FailedPrecondition(f"bucket {seq} has rows that its snapshot lacks")
            snap = meta["snap_dir"]
            b.update(files=[snap] if snap else [], tier=HOT, rows=meta["rows"], clean=meta["rows"], snap=snap)
            return b["rows"]

        rows = self._update(name, change)
        self._forget(name, seq)
        return rows is not None, rows or 0

    def evict_before(self, name: str, ts: int) -> int:
        """Drop the buckets that start before ts; how many. Their ids stay known."""
        return self._drop(name, lambda b, _: b["start"] < ts)

    def evict_oldest(self, name: str) -> int | None:
        seqs = [b["seq"] for b in self._get(name)["buckets"].values()]
        if not seqs:
            return None
        self._drop(name, lambda b, _: b["seq"] == min(seqs))
        return min(seqs)

    def _drop(self, name: str, which) -> int:
        for _ in range(TRIES):
            state, version = self._read(name)
            gone = [b for b in state["buckets"].values() if which(b, state)]
            files = [f for b in gone for f in b["files"]]
            ids = f"{self.blob or self.root}/{name}/gone/{uuid.uuid4().hex}"
            if files:
                self.spark.read.schema("vector_id long").parquet(*files).write.parquet(ids)
                state["gone_ids"].append(ids)
            for b in gone:
                del state["buckets"][str(b["seq"])]
            try:
                if gone:
                    self.files.write_json(self._manifest(name), state, version)
            except Aborted:
                self.files.delete(ids)
                continue
            if gone and self.blob:
                self._write_meta(name)
            for b in gone:
                self._forget(name, b["seq"])
                if self.blob:
                    self._bury(name, b["seq"])
            return len(gone)
        raise Aborted(f"{name} is changed by too many writers")

    # snapshots and recovery

    def _need_blob(self) -> None:
        if self.blob is None:
            raise FailedPrecondition("no blob store is configured")

    def _pointer(self, name: str, seq: int) -> str:
        return f"{self.blob}/{name}/seq_{seq}/bucket_meta"

    def _bury(self, name: str, seq: int) -> None:
        """A dropped bucket's pointer says so, until the next clean-up takes the folder."""
        self.files.write_json(self._pointer(name, seq), {"version": FORMAT, "seq": seq, "dropped": True})

    def _write_snapshot(self, name: str, b: dict, now: int) -> str | None:
        """The folder of a new snapshot of a bucket's files, beside its older ones; no pointer names it yet."""
        if not b["files"]:
            return None
        base = f"{self.blob}/{name}/seq_{b['seq']}"
        while self.files.exists(f"{base}/snap_{now}"):
            now += 1
        self.spark.read.schema(STORED).parquet(*b["files"]).write.parquet(f"{base}/snap_{now}")
        return f"{base}/snap_{now}"

    def _point(self, name: str, b: dict, target: str | None) -> bool:
        """Move a bucket's pointer to a snapshot that holds the rows it had in b, then mark these clean; False if it was dropped meanwhile."""
        meta = {"version": FORMAT, "seq": b["seq"], "created_at_secs": b["start"], "snap_dir": target, "rows": b["rows"]}
        if not self.has_bucket(name, b["seq"]):
            return False
        self.files.write_json(self._pointer(name, b["seq"]), meta)

        def change(state: dict) -> bool:
            now = state["buckets"].get(str(b["seq"]))
            if now is not None and now["clean"] <= b["rows"]:  # rows that came after stay dirty
                now.update(clean=b["rows"], snap=target)
            return now is not None

        live = self._update(name, change)
        if not live:
            self._bury(name, b["seq"])
        return live

    def snapshot_bucket(self, name: str, seq: int, now: int | None = None) -> bool:
        """Write a bucket beside its older snapshots, then move the pointer to it."""
        self._need_blob()
        b = self._get(name)["buckets"].get(str(seq))
        if b is None or b["tier"] == BLOB:
            return False
        return self._point(name, b, self._write_snapshot(name, b, _millis(now)))

    def snapshot(self, name: str, min_dirty: int = 1, now: int | None = None) -> list[int]:
        """Snapshot the changed buckets if they have min_dirty new rows together; the log goes up to there.

        The log's mark moves only if every bucket that was live at the start
        has all the rows of that time in a snapshot, or was dropped. A bucket
        that fails does not stop the others; its error is raised at the end.
        """
        self._need_blob()
        start = self._get(name)
        changed = [b for _, b in sorted(start["buckets"].items(), key=lambda x: int(x[0])) if b["rows"] > b["clean"]]
        if sum(b["rows"] - b["clean"] for b in changed) < max(1, min_dirty):
            return []
        with ThreadPoolExecutor(4) as pool:
            writes = [pool.submit(self._write_snapshot, name, b, _millis(now)) for b in changed]
        done, failed = [], None
        for b, write in zip(changed, writes, strict=True):
            try:
                if self._point(name, b, write.result()):
                    done.append(b["seq"])
            except Exception as e:  # noqa: BLE001  the others go on; raised below
                failed = failed or e
        if self._advance(name, start):
            self._write_meta(name, now)
            self._prune(name)
        self._write_catalog()
        if failed is not None:
            raise failed
        return done

    def _advance(self, name: str, start: dict) -> bool:
        """Move the log's mark to where it was in ``start`` if what was live then is committed now."""

        def change(state: dict) -> bool:
            live = {s: b for s, b in start["buckets"].items() if s in state["buckets"]}
            committed = {s for s, b in live.items() if state["buckets"][s]["clean"] >= b["rows"]}
            if committed != set(live):
                return False
            state["log_from"] = max(state["log_from"], start["entries"])
            return True

        return self._update(name, change)

    def _entries(self, root: str, name: str) -> list[str]:
        return [e for e in self.files.list(f"{root}/{name}/wal") if ENTRY.fullmatch(e) and self.files.version(f"{root}/{name}/wal/{e}")]

    def _prune(self, name: str) -> None:
        mark = self._get(name)["log_from"]
        for e in self.files.list(f"{self.root}/{name}/wal"):
            if (m := ENTRY.fullmatch(e)) and int(m[1]) < mark:
                self.files.delete(f"{self.root}/{name}/wal/{e}")

    def _write_meta(self, name: str, now: int | None = None) -> None:
        state = self._get(name)
        kept = {"wal_high_seq": state["log_from"], "next_seq": state["next_seq"], "gone_ids": state["gone_ids"]}
        self.files.write_json(f"{self.blob}/{name}/collection", {"version": FORMAT, **state["config"], "snapshot_at_secs": _millis(now) // 1000, **kept})

    def _write_catalog(self, without: str | None = None) -> None:
        entries = [{"name": n, **self._get(n)["config"]} for n in self.collections() if n != without]
        self.files.write_json(f"{self.blob}/catalog", {"version": FORMAT, "collections": entries})

    def vacuum(self, name: str, delay: bool = False) -> list[str]:
        """Delete snapshots that no pointer names and buckets that are no longer live.

        With ``delay`` only what the last call with ``delay`` found as well, so
        that a reader of the time before has a cycle to finish.
        """
        self._need_blob()
        state, gone = self._get(name), []
        used = {f for b in state["buckets"].values() for f in b["files"]}
        for folder in self.files.list(f"{self.blob}/{name}"):
            if not (m := SEQ.fullmatch(folder)):
                continue
            base = f"{self.blob}/{name}/{folder}"
            if m[1] not in state["buckets"]:
                gone.append(base)
                continue
            kept = (self.files.read_json(f"{base}/bucket_meta") or {}).get("snap_dir")
            gone += [f"{base}/{s}" for s in self.files.list(base) if s.startswith("snap_") and f"{base}/{s}" != kept and f"{base}/{s}" not in used]
        if delay:
            last = self.files.read_json(f"{self.blob}/{name}/stale") or {"paths": []}
            self.files.write_json(f"{self.blob}/{name}/stale", {"version": FORMAT, "paths": gone})
            gone = [path for path in gone if path in last["paths"]]
        for path in gone:
            self.files.delete(path)
        return gone

    def vacuum_local(self, name: str) -> list[str]:
        """Delete local rows that neither the manifest nor the log names. Nothing may be inserting meanwhile."""
        state, kept = self._get(name), set(self._entries(self.root, name))
        used = {f for b in state["buckets"].values() for f in b["files"]}
        base, gone = f"{self.root}/{name}/data", []
        for entry in self.files.list(base):
            if entry not in kept:
                gone += [f"{base}/{entry}/{p}" for p in self.files.list(f"{base}/{entry}") if p.startswith("part=") and f"{base}/{entry}/{p}" not in used]
        gone += [f"{self.root}/{name}/staging/{s}" for s in self.files.list(f"{self.root}/{name}/staging")]
        for path in gone:
            self.files.delete(path)
        return gone

    def recover(self, log_root: str | None = None, replace: bool = False) -> DataFrame:
        """Rebuild the catalogued collections in this root from the blob store and the log left behind.

        Returns collection, bucket_seq, state, rows. A collection that this
        root has is left as it is ('kept'), unless ``replace``. A bucket is
        'restored', or the state says what went wrong: one that cannot be read
        does not stop the others. Rows of the log come back to the buckets that
        they were dealt to.
        """
        self._need_blob()
        catalog = self.files.read_json(f"{self.blob}/catalog")
        if catalog:
            configs = {c["name"]: {k: v for k, v in c.items() if k != "name"} for c in catalog["collections"]}
        else:
            configs = {n: None for n in self.files.list(self.blob) if self.files.version(f"{self.blob}/{n}/collection")}
        report: list[tuple] = []
        for name, config in sorted(configs.items()):
            _, version = self.files.read_version(self._manifest(name))
            if version and not replace:
                report.append((name, None, "kept", self.count(name)))
                continue
            self._recover(name, config, log_root or self.root, version, report)
        return self.spark.createDataFrame(report, "collection string, bucket_seq int, state string, rows long")

    def _recover(self, name: str, config: dict | None, log_root: str, version: int, report: list) -> None:
        meta = self.files.read_json(f"{self.blob}/{name}/collection") or {}
        config = config or {k: meta[k] for k in ("dim", "m", "m_max0", "ef_construction", "bucket_duration_secs")}
        state = self._fresh(config) | {k: meta[v] for k, v in (("next_seq", "next_seq"), ("gone_ids", "gone_ids"), ("log_from", "wal_high_seq")) if v in meta}
        tail = [e for e in self._entries(log_root, name) if int(ENTRY.fullmatch(e)[1]) >= state["log_from"]]
        marks = {e: self.files.read_json(f"{log_root}/{name}/wal/{e}") for e in tail}  # all is read before anything is written
        state["entries"] = max([state["log_from"], *(int(ENTRY.fullmatch(e)[1]) + 1 for e in tail)])
        for folder in sorted((f for f in self.files.list(f"{self.blob}/{name}") if SEQ.fullmatch(f)), key=lambda f: int(f[4:])):
            seq = int(folder[4:])
            state["next_seq"] = max(state["next_seq"], seq + 1)
            try:
                b = self.files.read_json(self._pointer(name, seq))
                if b is None:
                    raise NotFound("no pointer")
                if b.get("dropped"):
                    continue
                if b["snap_dir"]:
                    rows = self.spark.read.schema(STORED).option("parquet.page.verify-checksum.enabled", "true").parquet(b["snap_dir"]).count()
                    if rows != b["rows"]:
                        raise Internal(f"{rows} rows instead of {b['rows']}")
            except Exception as e:  # noqa: BLE001  reported, so that the other buckets come back
                report.append((name, seq, type(e).__name__, 0))
                continue
            snap = b["snap_dir"]
            state["buckets"][str(seq)] = {"seq": seq, "start": b["created_at_secs"], "tier": HOT, "files": [snap] if snap else [], "rows": b["rows"], "clean": b["rows"], "snap": snap}
            report.append((name, seq, "restored", b["rows"]))
        for e in tail:
            if marks[e]["kind"] == "rotate" and str(marks[e]["seq"]) not in state["buckets"]:
                self._seat(state, marks[e]["start"], marks[e]["seq"])
        base = f"{log_root}/{name}/data"
        paths = [f"{base}/{e}/{p}" for e in tail for p in self.files.list(f"{base}/{e}") if p.startswith("part=")]
        entry, written = f"{state['entries']:012d}-{uuid.uuid4().hex[:8]}", None
        if paths:
            rows = self.spark.read.schema(STORED).parquet(*paths).withColumn("arrival", F.regexp_extract("_metadata.file_path", "/data/([0-9]{12}-[0-9a-f]{8})/", 1))
            span = rows.agg(F.count("*"), F.min("vector_id"), F.max("vector_id")).first()
            taken = I.accepted(rows, self._known(state, rows, tuple(span)))
            written = self._place(name, state, taken.drop("arrival"), entry)
        if written is not None:
            # the rows are in a new entry, which the log keeps until they are snapshotted; the old entries may stay, as their ids are known
            self.files.write_json(f"{self.root}/{name}/wal/{entry}", {"kind": "insert"}, after=0)
            state["entries"] += 1
        state["inserts"] = state["entries"]
        self.files.write_json(self._manifest(name), state, version)
        for n, seq in list(self._cached):
            if n == name:
                self._forget(name, seq)


def _millis(now: int | None) -> int:
    return now if now is not None else int(time.time() * 1000)
