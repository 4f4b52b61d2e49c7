"""Results over tables in folders, rows that are no multiple of four, copies, clusters and large k."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidegrid.operators import hnsw, knn
from tidegrid.plans.queries import QUERIES
from tidegrid.types import CollectionConfig


@pytest.fixture
def table(spark, tmp_path):
    """A writer of embeddings.parquet as a folder of files."""

    def write(vectors):
        rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(vectors)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return write


class Batches:
    """Stands for a corpus: gives the function that a task runs."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        return type("Shared", (), {"value": value})

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        return work


def scan(ids, vectors, asked, k):
    work = knn._scan(Batches(), np.arange(len(asked)), asked, k, "l2sq", "vector_id", "vector", [], (), False, "query_id long, vector_id long, distance double", None, [])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.astype(np.float32).reshape(-1)))
    return work(iter([pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["vector_id", "vector"])]))


def test_a_task_holds_few_pairs_however_large_k_is(spark):
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(1000, 16)), rng.normal(size=(3000, 16))
    count, largest = 0, 0
    tracemalloc.start()
    for batch in scan(np.arange(1000), base, asked, 1_000_000):
        count, largest = count + batch.num_rows, max(largest, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 3_000_000 and largest <= 2 * knn.OUT_ROWS and peak < 150 << 20


def test_copies_send_no_more_than_k_rows(spark):
    """Of many vectors at the same distance the least ids are sent."""
    sent = pa.Table.from_batches(scan(np.arange(400)[::-1], np.ones((400, 4)), np.zeros((5, 4)), 3)).to_pandas()
    assert len(sent) == 15 and set(sent["vector_id"]) == {0, 1, 2}


def test_what_has_no_order_comes_last(spark):
    rows = spark.createDataFrame([(i, [float("nan") if i % 2 else float(i), 0.0]) for i in range(24)], "vector_id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, query array<double>")
    hits = knn.knn_batch(rows, asked, 13).orderBy("rank").collect()
    assert [r["vector_id"] for r in hits] == [*range(0, 24, 2), 1]


def test_every_bucket_gives_its_nearest(spark, table):
    """Also one whose nearest rows are behind a thousand others of other buckets."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1603, 4)).astype(np.float32)
    x[1600:] += 100
    got = {}
    for r in QUERIES["knn_per_bucket"](spark, table(x)).orderBy("query_id", "bucket_seq", "rank").collect():
        got.setdefault((r["query_id"], r["bucket_seq"]), []).append(r["vector_id"])
    gaps = ((x[::100, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(-1)
    assert got == {(q, b): [i for i in np.argsort(gaps[q // 100], kind="stable").tolist() if i // 400 == b][:3] for q in range(0, 1603, 100) for b in range(5)}


@pytest.mark.parametrize("n", [8, 11])
def test_reset_goes_on_at_the_fourth_number(spark, table, n):
    rows = QUERIES["reset_collection"](spark, table(np.ones((n, 64)))).collect()
    assert {r["vector_id"]: r["bucket_seq"] for r in rows} == {i: i // 2 + 4 for i in range(n)}


def test_a_stream_reads_a_folder_of_files_and_one_file(spark, table, tmp_path):
    where = table(np.ones((10, 64)))
    want = {i: i // 2 for i in range(10)}
    assert {r["vector_id"]: r["bucket_seq"] for r in QUERIES["stream_ingest"](spark, where).collect()} == want
    (tmp_path / "one").mkdir()
    pq.write_table(pq.read_table(f"{where}/embeddings.parquet"), tmp_path / "one" / "embeddings.parquet")
    assert {r["vector_id"]: r["bucket_seq"] for r in QUERIES["stream_ingest"](spark, str(tmp_path / "one")).collect()} == want


def clusters(n, of, far=50.0):
    rng = np.random.default_rng(4)
    return (rng.normal(size=(n // of + 1, 64)) * far)[np.arange(n) % (n // of + 1)] + rng.normal(size=(n, 64)) * 1e-3


def test_a_shard_is_built_without_beams(monkeypatch):
    """The candidates are the nearest of the nodes before; edges go both ways, within their bounds, and reach every node."""
    c = CollectionConfig(dim=64, m=4, m_max0=8, ef_construction=16)
    x, levels = clusters(400, 40), np.array([hnsw.level_of(i, 4) for i in range(400)])
    g = hnsw.Graph(c)
    with monkeypatch.context() as m:
        m.setattr(hnsw.Graph, "beam", None)
        g.fill(x, levels)
    assert g.entry == levels.argmax() and len(g.components()) == 1
    for a, lists in enumerate(g.edges):
        assert len(lists) == levels[a] + 1
        for lv, near in enumerate(lists):
            assert len(near) == len(set(near)) <= g.cap(lv) and a not in near and all(a in g.edges[b][lv] for b in near)
    for place, gaps, near in hnsw.nearest_before(x, 16, "l2sq"):
        want = ((x[:place] - x[place]) ** 2).sum(1)
        assert np.allclose(np.sort(gaps), np.sort(want)[:16], atol=1e-6) and len(set(near.tolist())) == min(place, 16)


def test_full_components_are_tied_together():
    """Two circles of nodes without room each give up an edge for the tie."""
    g = hnsw.Graph(CollectionConfig(dim=1, m=2, m_max0=2, ef_construction=4))
    g.vectors, g.entry = np.arange(6.0)[:, None], 0
    g.edges = [[[1, 2]], [[0, 2]], [[0, 1]], [[4, 5]], [[3, 5]], [[3, 4]]]
    g.connect()
    assert len(g.components()) == 1 and max(len(e[0]) for e in g.edges) <= 2


def test_a_beam_over_all_nodes_is_exact_among_clusters(spark, table):
    x = clusters(803, 400).astype(np.float32)
    rows = QUERIES["hnsw_exact"](spark, table(x)).orderBy("query_id", "rank").collect()
    gaps = np.round(((x[::100, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(-1), 9)
    want = {q: sorted(range(803), key=lambda i: (gaps[q // 100][i], i))[:10] for q in range(0, 803, 100)}
    assert {q: [r["vector_id"] for r in rows if r["query_id"] == q] for q in want} == want


def test_distances_are_rounded_before_the_cut(spark):
    """Two nodes whose distances differ in the tenth digit alone are ranked by their ids."""
    c = CollectionConfig(dim=1, m=2, m_max0=4, ef_construction=8)
    stored = spark.createDataFrame([(0, 0, 0, 7, [1.0]), (0, 0, 1, 3, [1.0 + 1e-11]), (0, 0, 2, 5, [9.0])], "bucket_seq int, bucket_start long, ts long, vector_id long, vector array<double>")
    asked = spark.createDataFrame([(0, [0.0])], "query_id long, query array<double>")
    assert [r["vector_id"] for r in hnsw.search(hnsw.build(stored, c), asked, c, 1, 9, digits=9).collect()] == [3]


def test_the_size_of_a_bucket_is_that_of_all_its_shards(spark, table, monkeypatch):
    build = hnsw.build
    monkeypatch.setattr(hnsw, "build", lambda stored, config: build(stored, config, 40))
    rows = QUERIES["graph_sizes"](spark, table(np.random.default_rng(3).normal(size=(403, 64)))).collect()
    level = [hnsw.level_of(i, 16) for i in range(403)]
    ids = {b: range(100 * b, min(403, 100 * b + 100)) for b in range(5)}
    want = {(b, 0, len(of), 64, max(level[i] for i in of), max(of, key=lambda i: (level[i], -i))) for b, of in ids.items()}
    assert {(r["bucket_seq"], r["shard"], r["nodes"], r["dim"], r["top_level"], r["entry"]) for r in rows} == want and len(rows) == 5
