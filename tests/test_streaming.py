"""Windows, deduplication and snapshots on streams, and that the package holds without its optional part."""

import datetime as dt
import os
import shutil
import subprocess
import sys

import pytest

from tidegrid.plans.engine import Engine
from tidegrid.streaming.ingest import first_seen, snapshots, window_counts
from tidegrid.types import CollectionConfig

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def run(frame, name, spark):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture
def events(spark, tmp_path):
    rows = [(0, at(1), "a"), (1, at(4), "a"), (1, at(6), "b"), (2, at(7), "b"), (3, at(59), "a")]
    spark.createDataFrame(rows, "vector_id long, ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("vector_id long, ts timestamp, kind string").parquet(str(tmp_path / "in"))


def test_windows_close_behind_the_watermark(spark, events):
    got = {(r["window_start"].minute, r["kind"]): r["n"] for r in run(window_counts(events, "ts", "5 minutes", "1 minute", "kind"), "windows", spark)}
    assert got == {(0, "a"): 2, (5, "b"): 2}


def test_first_of_each_id(spark, events):
    assert sorted(r["vector_id"] for r in run(first_seen(events, "ts", "1 hour"), "firsts", spark)) == [0, 1, 2, 3]


def test_stream_with_snapshots(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"), str(tmp_path / "blob"))
    engine.create_collection("c", CollectionConfig(2, bucket_duration_secs=10))
    source = str(tmp_path / "in")
    spark.createDataFrame([(k, k, [1.0, float(k)]) for k in range(25)], "vector_id long, ts long, vector array<float>").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("vector_id long, ts long, vector array<float>").parquet(source)
    assert snapshots(stream, engine, "c", str(tmp_path / "checkpoint"), 5).awaitTermination(120)
    assert engine.dirty("c") == {0: 0, 1: 0, 2: 0} and engine.files.list(str(tmp_path / "root/c/wal")) == []


def test_the_rest_stands_without_the_optional_part(tmp_path):
    for name in ("tidegrid", "__spark_entry__.py", "bench.py"):
        source = os.path.join(TOP, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tidegrid" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
