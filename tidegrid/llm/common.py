"""Helpers shared by the operators: tables, shared storage, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import shared_dir

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim() -> None:
    """Give memory that a Python worker no longer needs back to the machine: workers stay for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """work for mapInArrow; the worker then gives back what it no longer needs."""

    def done(batches):
        yield from work(batches)
        trim()

    return done


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there.

    The files outlive lost executors and go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*written: DataFrame) -> None:
    """Delete materialised DataFrames that nothing reads any more: what was made of them is materialised, too."""
    for df in written:
        _written.remove((df.sparkSession, df._written_to))
        _delete(df.sparkSession, df._written_to)
    release(written[0].sparkSession)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 4) -> None:
    """Make Python workers ready: the package's sources, and Arrow batches of bounded size whatever the rows' lengths."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def release(spark: SparkSession) -> None:
    """Let go of shuffle files behind DataFrames that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe_broadcast(df: DataFrame, row_bytes: int, limit_mb: int = 64) -> DataFrame:
    """Broadcast a materialised df if its counted size is under the limit.

    Beyond the limit df comes back unmarked and joins go by a shuffle.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit_mb << 20 else df


def _united(batches):
    """Union-find over one task's edges, the least id of a set as its root."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["id", "component"])


LOCAL_EDGES = 1 << 20


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for all ids of edges(a, b); component: least id reachable.

    Up to ``local_edges`` distinct edges, counted first, are united by one
    task. Beyond that large-star and small-star steps alternate until the
    edges are stars around the least ids. Each round is one aggregation and
    one join, which Spark can split at a hub; no neighbour list is gathered.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    if now.count() <= local_edges:
        ship(edges.sparkSession)
        return now.coalesce(1).mapInArrow(_united, "id long, component long")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # every row of `large` has a > b; small star links the lower neighbours to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("x"), F.col("m").alias("y")).union(small.select("a", "m"))
        nxt = materialize(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        stars = state[0] == state[2] and nxt.join(nxt.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
        now = nxt
        if stars or tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
