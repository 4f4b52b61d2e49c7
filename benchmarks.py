"""Insert, search, graphs, files and cold load at a chosen scale: ``python benchmarks.py [rows] [graph rows] [dim]``; one JSON line.

The vectors are drawn around seeded centres, as no table of that size is
given. ``bench.py`` times the queries over the given tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import vectors as V
from tidegrid.operators import evaluate as E
from tidegrid.operators import hnsw
from tidegrid.operators.knn import knn_batch
from tidegrid.plans.engine import Engine
from tidegrid.sources import vecs
from tidegrid.storage import shared_dir
from tidegrid.types import CollectionConfig


def drawn(spark: SparkSession, rows: int, dim: int, seed: int) -> DataFrame:
    """vector_id, ts, vector, arrival: rows around 100 centres."""
    ids = spark.range(rows).withColumn("c", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100)))
    one = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: ((F.pmod(F.xxhash64("c", j), F.lit(1000)) + F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(600))) / 1000.0).cast("float"))
    return ids.select(F.col("id").alias("vector_id"), F.col("id").alias("ts"), one.alias("vector"), F.col("id").alias("arrival"))


def seconds(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main(rows: int = 100_000, graph_rows: int = 20_000, dim: int = 128) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base, out = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}", {"rows": rows, "graph_rows": graph_rows, "dim": dim, "cpus": int(cpus)}
    drawn(spark, rows, dim, 1).write.parquet(f"{base}/rows")
    drawn(spark, 1000, dim, 2).select(F.col("vector_id").alias("query_id"), F.col("vector").alias("query")).write.parquet(f"{base}/queries")
    source, queries = spark.read.parquet(f"{base}/rows"), spark.read.parquet(f"{base}/queries")
    noop(knn_batch(source.limit(1000), queries.limit(10), 10))  # start the workers

    config = CollectionConfig(dim=dim, m=16, m_max0=32, ef_construction=100, bucket_duration_secs=max(1, rows // 4))
    engine = Engine(spark, f"{base}/root", f"{base}/blob")
    engine.create_collection("c", config)
    step, took = rows // 4, []
    for k in range(4):  # each batch meets the ids of those before
        took.append(seconds(lambda k=k: engine.batch_insert("c", source.where((F.col("vector_id") >= k * step) & (F.col("vector_id") < (k + 1) * step)))))
    out["insert_vectors_per_sec"], out["insert_batch_sec"] = round(4 * step / sum(took)), [round(t, 2) for t in took]
    out["snapshot_sec"] = round(seconds(lambda: engine.snapshot("c")), 2)

    def cold() -> None:
        again = Engine(spark, f"{base}/cold", f"{base}/blob")
        again.recover()
        noop(again.search("c", queries.limit(1), 10))

    out["cold_load_and_first_query_sec"] = round(seconds(cold), 2)
    out["exact_queries_per_sec"] = round(1000 / seconds(lambda: noop(engine.search("c", queries, 10))), 1)
    sweep = {}
    for threads in (1, 2, 4):  # single queries from several callers
        asked = [queries.where(F.col("query_id") == k) for k in range(8)]
        with ThreadPoolExecutor(threads) as pool:
            began = time.perf_counter()
            each = sorted(pool.map(lambda q: seconds(lambda: noop(engine.search("c", q, 10))), asked))
            sweep[threads] = {"qps": round(8 / (time.perf_counter() - began), 2), "p50": round(each[3], 3), "p95": round(each[7], 3), "p99": round(each[7], 3)}
    out["single_query_sweep"] = sweep

    part = engine.stored("c").where(F.col("vector_id") % max(1, rows // graph_rows) == 0)
    path = f"{base}/graph"
    took_build = seconds(lambda: hnsw.build(part, config, shard_rows=max(1000, graph_rows // 8)).write.parquet(path))
    nodes = spark.read.schema(hnsw.NODES).parquet(path)
    count = nodes.count()
    out["graph_build_vectors_per_sec"] = round(count / took_build)
    found = f"{base}/hits"
    out["graph_queries_per_sec"] = round(1000 / seconds(lambda: hnsw.search(nodes, queries, config, 10, 100).write.parquet(found)), 1)
    truth = knn_batch(part, queries, 10)
    out["graph_recall"] = {k: round(v, 4) for k, v in E.recall_stats(E.recall_per_query(truth, spark.read.parquet(found))).first().asDict().items()}

    vecs.register(spark)
    file = f"{base}/vecs"
    values = source.select(F.col("vector_id").alias("row_id"), F.col("vector").alias("values"))
    mb = rows * (4 + 4 * dim) / 1e6
    out["fvecs_write_mb_per_sec"] = round(mb / seconds(lambda: values.write.format("fvecs").mode("append").save(file)), 1)
    out["fvecs_read_mb_per_sec"] = round(mb / seconds(lambda: noop(spark.read.format("fvecs").load(file))), 1)
    micro = {}
    for d in (64, 128, 512, 1536):
        a = F.array_repeat(F.col("id").cast("double"), d)
        pairs = spark.range(20_000).select(a.alias("a"), F.reverse(a).alias("b"))
        micro[d] = round(20_000 / seconds(lambda pairs=pairs: noop(pairs.select(V.distance("a", "b", "l2sq")))))
    out["distance_pairs_per_sec"] = micro
    one = np.random.default_rng(0).normal(size=(2000, dim))
    out["kernel_pairs_per_sec"] = round(4e6 / seconds(lambda: one @ one.T))
    out["driver_python_mb"] = [round(x / 1e6) for x in E.resident_bytes()]
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
