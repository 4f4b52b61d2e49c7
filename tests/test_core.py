"""Small fixtures: distances, buckets, search, ingest, retention, evaluation."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.errors import InvalidArgument
from tidegrid.functions import codecs as C
from tidegrid.functions import vectors as V
from tidegrid.functions.buckets import in_range, slot
from tidegrid.operators import buckets as B
from tidegrid.operators import evaluate as E
from tidegrid.operators import hnsw, ivf
from tidegrid.operators import ingest as I
from tidegrid.operators.knn import knn_batch, knn_single, top_k
from tidegrid.shipping import ship
from tidegrid.types import CollectionConfig


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def vecs(spark, rows):
    return spark.createDataFrame([(i, t, [float(x) for x in v], k) for k, (i, v, t) in enumerate(rows)], "vector_id long, ts long, vector array<float>, arrival long")


def queries(spark, *rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "query_id long, query array<double>")


def test_distances(spark):
    assert one(spark, V.dot_product(arr(*[1] * 8), arr(*[2] * 8))) == 16
    assert one(spark, V.cosine_distance(arr(1, 2), arr(1, 2))) == pytest.approx(0)
    assert one(spark, V.cosine_distance(arr(1, 0), arr(0, 1))) == 1
    assert one(spark, V.cosine_distance(arr(0, 0), arr(0, 1))) == 1
    assert one(spark, V.euclidean_distance(arr(*[0] * 8), arr(*[1] * 8))) == pytest.approx(math.sqrt(8))
    assert one(spark, V.normalize(arr(3, 4, 0))) == pytest.approx([0.6, 0.8, 0])
    assert one(spark, V.normalize(arr(0, 0))) == [0, 0]
    with pytest.raises(Exception, match="dimension mismatch"):
        one(spark, V.distance(arr(1), arr(1, 2)))
    with pytest.raises(InvalidArgument):
        V.distance("a", "b", "manhattan")


def test_codecs(spark):
    block, offset = C.node_position(C.node_id(F.lit(5), F.lit(64)))
    assert (one(spark, block), one(spark, offset)) == (5, 64)
    assert one(spark, C.wal_name(F.lit(7))) == "00000000000000000007.wal"
    assert one(spark, C.wal_number(F.lit("a/00000000000000000007.wal"))) == 7
    assert one(spark, C.bucket_number(F.lit("x"))) is None
    assert one(spark, C.snapshot_number(C.snapshot_name(F.lit(12)))) == 12
    assert one(spark, C.estimate_memory_bytes(F.lit(128), F.lit(16), F.lit(32), F.lit(0))) == 640
    assert one(spark, C.vectors_per_block(F.lit(2 << 20), F.lit(128))) == (2 << 20) // 520
    assert one(spark, C.penalised_score(F.lit(1.0), F.lit(16), F.lit(32))) == pytest.approx(1.4)
    assert one(spark, C.geometric_level(F.lit(1.0), 16)) == 0 and one(spark, C.geometric_level(F.lit(1e-300), 2)) == 32


def test_bucket_boundaries(spark):
    rows = vecs(spark, [(k, [0, 0, 0, 0], t) for k, t in enumerate((0, 5, 9, 10))])
    stored = B.sequence(B.assign(rows, 10))
    assert {r["vector_id"]: r["bucket_seq"] for r in stored.collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    assert [r["n"] for r in B.counts(stored).orderBy("bucket_seq").collect()] == [3, 1]


def test_late_rows_go_to_the_newest_bucket(spark):
    rows = vecs(spark, [(0, [0], 0), (1, [0], 25), (2, [0], 3), (3, [0], 31), (4, [0], 12)])
    got = {r["vector_id"]: r["bucket_start"] for r in B.assign(rows, 10).collect()}
    assert got == {0: 0, 1: 20, 2: 20, 3: 30, 4: 30}
    own = {r["vector_id"]: r["bucket_start"] for r in B.assign(rows, 10, "event_time").collect()}
    assert own == {0: 0, 1: 20, 2: 0, 3: 30, 4: 10}
    assert B.assign(rows, 10, newest=50).select("bucket_start").distinct().collect()[0][0] == 50
    assert B.assign(rows.limit(0), 10).count() == 0


RANGE = [(0, [1, 0, 0, 0], 0), (1, [9, 0, 0, 0], 5), (2, [2, 0, 0, 0], 10), (3, [9, 0, 0, 0], 15), (4, [3, 0, 0, 0], 20)]


@pytest.mark.parametrize(("lo", "hi", "ids"), [(0, 10, [0, 1]), (10, 20, [2, 3]), (5, 25, [0, 2, 4, 1, 3]), (5, 5, []), (100, 200, []), (None, 7, [0, 2, 4, 1, 3])])
def test_time_range_selects_whole_buckets(spark, lo, hi, ids):
    stored = B.sequence(B.assign(vecs(spark, RANGE), 10)).where(in_range("bucket_start", lo, hi, 10))
    hits = knn_batch(stored, queries(spark, [0] * 4), 10, keep=("bucket_seq",), order=("bucket_seq",))
    assert [r["vector_id"] for r in hits.orderBy("rank").collect()] == ids


def test_recency_can_flip_the_order(spark):
    stored = B.sequence(B.assign(vecs(spark, [(0, [0.1, 0, 0, 0], 0), (1, [1, 0, 0, 0], 1)]), 1))
    plain = knn_batch(stored, queries(spark, [0] * 4), 1, keep=("bucket_start",), per=("bucket_seq",))
    assert plain.first()["vector_id"] == 0
    adjust = B.recency("penalty", penalties={0: 1000.0})(F.col("bucket_start"), F.col("distance"))
    assert knn_batch(stored, queries(spark, [0] * 4), 1, keep=("bucket_start",), per=("bucket_seq",), adjust=adjust).first()["vector_id"] == 1


def test_best_over_buckets(spark):
    rows = vecs(spark, [(i, [i * 4 + j for j in range(4)], i // 5) for i in range(15)])
    hits = knn_batch(B.sequence(B.assign(rows, 1)), queries(spark, [0] * 4), 3, per=("bucket_seq",)).orderBy("rank").collect()
    assert [(r["vector_id"], r["distance"]) for r in hits] == [(0, 14), (1, 126), (2, 366)]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base, asked = rng.normal(size=(300, 12)).astype(np.float32), rng.normal(size=(9, 12))
    base[17] = base[140]  # a tie
    rows = vecs(spark, [(i, v, i) for i, v in enumerate(base)])
    for metric in ("l2sq", "l2", "cosine", "neg_dot"):
        hits = knn_batch(rows, queries(spark, *asked), 7, metric).orderBy("query_id", "rank").collect()
        for q, v in enumerate(asked):
            x = base.astype(np.float64)
            d = {"l2sq": ((x - v) ** 2).sum(1), "l2": np.sqrt(((x - v) ** 2).sum(1)), "neg_dot": -(x @ v), "cosine": 1 - (x @ v) / np.linalg.norm(x, axis=1) / np.linalg.norm(v)}[metric]
            assert [r["vector_id"] for r in hits if r["query_id"] == q] == sorted(range(300), key=lambda i: (round(d[i], 9), i))[:7]
    assert [r["vector_id"] for r in knn_single(rows, base[140].tolist(), 2).collect()] == [17, 140]


def test_knn_edge_cases(spark):
    rows = vecs(spark, [(0, [1, 2], 0)])
    assert knn_batch(rows.limit(0), queries(spark, [0, 0]), 3).count() == 0
    assert knn_batch(rows, queries(spark, [0, 0]).limit(0), 3).count() == 0
    assert knn_batch(rows, queries(spark, [0, 0]), 3).count() == 1
    for bad in (lambda: knn_batch(rows, queries(spark, [0, 0]), 0), lambda: knn_single(rows, [], 1), lambda: knn_batch(rows, queries(spark, [0, 0]), 1, "dot")):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(Exception, match="dimension mismatch"):
        knn_batch(rows, queries(spark, [0, 0, 0]), 1).collect()


def test_top_k(spark):
    rows = spark.createDataFrame([(0, 5, 1.0), (0, 2, 1.0), (0, 9, 0.5), (0, 7, 2.0)], "g int, id int, d double")
    assert [r["id"] for r in top_k(rows, 3, ["g"], ["d", "id"]).orderBy("rank").collect()] == [9, 2, 5]
    assert top_k(rows, 0, ["g"], ["d"]).count() == 0 and top_k(rows, 9, ["g"], ["d"]).count() == 4


def test_ingest(spark):
    rows = vecs(spark, [(0, [0] * 4, 0), (1, [1] * 4, 5), (2, [2] * 4, 10), (0, [3] * 4, 15)])
    I.validate(rows, 4)
    assert sorted((r["vector_id"], r["ts"]) for r in I.accepted(rows, None).collect()) == [(0, 0), (1, 5), (2, 10)]
    assert [r["ts"] for r in I.skipped(rows, None).collect()] == [15]
    assert I.accepted(rows, rows).count() == 0
    for bad in ([(0, [1.0], 0)], [(-1, [1.0] * 4, 0)], [(0, [], 0)]):
        with pytest.raises(InvalidArgument):
            I.validate(vecs(spark, bad), 4)


def test_retention(spark):
    stored = B.sequence(B.assign(vecs(spark, [(k, [0], k) for k in range(3)]), 1))
    kept, gone = B.evict_before(stored, 2)
    assert (kept.count(), gone) == (1, 2)
    assert B.evict_oldest(stored)[1] == 0 and B.evict_oldest(stored.limit(0))[1] is None
    assert B.evict_before(B.sequence(B.assign(vecs(spark, [(0, [0], 10)]), 10)), 5)[1] == 0


def test_evaluation(spark):
    def recall(truth, found):
        t = spark.createDataFrame([(0, i) for i in truth], "query_id long, vector_id long")
        f = spark.createDataFrame([(0, i) for i in found], "query_id long, vector_id long")
        return E.recall_per_query(t, f).first()["recall"]

    assert recall([1, 2, 3, 4], [1, 9, 2, 8]) == 0.5 and recall([1], [1]) == 1 and recall([1], []) == 0
    with pytest.raises(Exception, match="at least one true id"):
        one(spark, V.recall_at_k(F.array().cast("array<int>"), F.array(F.lit(1))))
    for value, state in ((float("nan"), "not_finite"), (float("inf"), "not_finite"), (-0.01, "out_of_range"), (1.01, "out_of_range"), (0.5, "ok")):
        assert one(spark, V.validate_recall_score(F.lit(value))) == state
    stats = E.recall_stats(spark.createDataFrame([(k / 20,) for k in range(1, 21)], "recall double")).first()
    assert tuple(stats) == pytest.approx((0.05, 0.525, 0.95))
    assert tuple(E.recall_stats(spark.createDataFrame([], "recall double")).first()) == (0, 0, 0)
    ids = np.arange(6).reshape(2, 3)
    raw = E.truth_bytes(ids, 10)
    assert (E.truth_ids(raw, 10, 2, 3) == ids).all() and E.truth_ids(raw, 11, 2, 3) is None and E.truth_ids(b"x", 1, 1, 1) is None
    assert struct.unpack("<QQQ", raw[4:28]) == (10, 2, 3)


def test_graph_edge_eviction():
    """A full list takes a nearer neighbour for its farthest one, which loses the way back, and no farther one."""
    g = hnsw.Graph(CollectionConfig(dim=2, m=2, m_max0=2, ef_construction=4))
    g.vectors = np.array([[3, 4], [3, 9], [-9, 4], [3, 5], [8, 8]], float)  # from the first: 5, 12, 1 and 6.4
    g.edges = [[[]] for _ in range(5)]
    g.edges[1][0], g.edges[2][0] = [0], [0]
    assert g.link(0, 1, 0) and g.link(0, 2, 0) and g.link(0, 3, 0)
    assert sorted(g.edges[0][0]) == [1, 3] and g.edges[1][0] == [0] and g.edges[2][0] == []
    assert not g.link(0, 2, 0) and not g.link(0, 4, 0) and g.link(0, 1, 0) and sorted(g.edges[0][0]) == [1, 3]


def test_graph_recall(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(200, 8)).tolist()
    asked = rng.normal(size=(10, 8)).tolist()
    c = CollectionConfig(dim=8, m=8, m_max0=16, ef_construction=128)
    stored = B.sequence(B.assign(vecs(spark, [(i, v, i) for i, v in enumerate(base)]), 100))
    nodes = hnsw.build(stored, c)
    hits = hnsw.search(nodes, queries(spark, *asked), c, 10, 64)
    truth = knn_batch(stored, queries(spark, *asked), 10)
    assert E.recall_per_query(truth, hits).agg(F.avg("recall")).first()[0] >= 0.9
    assert [r["rank"] for r in hits.where("query_id = 3").orderBy("rank").collect()] == list(range(1, 11))
    assert sum(r["n"] for r in hnsw.level_histogram(nodes).collect()) == 200 and {(r["nodes"], r["dim"]) for r in hnsw.describe(nodes).collect()} == {(100, 8)}
    caps = hnsw.edges(nodes).select(F.max(F.when(F.col("level") == 0, F.size("neighbors"))), F.max(F.when(F.col("level") > 0, F.size("neighbors")))).first()
    assert caps[0] <= 16 and (caps[1] or 0) <= 8


def test_inverted_file_is_exact_when_all_cells_are_probed(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 6))
    rows = vecs(spark, [(i, v, i) for i, v in enumerate(base)])
    asked = queries(spark, *base[:5])
    centres = ivf.train(rows, 4)
    truth = {(r["query_id"], r["vector_id"]) for r in knn_batch(rows, asked, 5).collect()}
    assert {(r["query_id"], r["vector_id"]) for r in ivf.search(rows, asked, centres, 5, 4).collect()} == truth


def test_slot(spark):
    assert [one(spark, slot(F.lit(t).cast("long"), 10)) for t in (0, 9, 10, 25)] == [0, 0, 10, 20]


def test_pruning_reaches_the_scan(spark, tmp_path):
    B.assign(vecs(spark, RANGE), 10).write.partitionBy("bucket_start").parquet(str(tmp_path / "v"))
    cut = spark.read.parquet(str(tmp_path / "v")).where(in_range("bucket_start", 5, 15, 10)).select("vector_id")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_start" in plan and "ReadSchema: struct<vector_id:bigint>" in plan


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e7, 1e8])
def test_knn_far_from_the_origin(spark, offset):
    rng = np.random.default_rng(8)
    base, asked = offset + 8 * rng.integers(-50, 50, size=(400, 16)), offset + 8 * rng.integers(-50, 50, size=(5, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base.astype(float))], "vector_id long, vector array<double>").repartition(3)
    hits = knn_batch(rows, queries(spark, *asked), 10).orderBy("query_id", "rank").collect()
    for q, v in enumerate(asked):
        d = ((base - v) ** 2).sum(1)
        assert [(r["vector_id"], r["distance"]) for r in hits if r["query_id"] == q] == [(i, d[i]) for i in sorted(range(400), key=lambda i: (d[i], i))[:10]]


def test_knn_in_chunks_of_queries(spark, monkeypatch):
    from tidegrid.operators import knn

    rng = np.random.default_rng(5)
    rows = vecs(spark, [(i, v, i) for i, v in enumerate(rng.normal(size=(60, 4)))])
    asked = queries(spark, *rng.normal(size=(40, 4)))
    whole = sorted(map(tuple, knn_batch(rows, asked, 3).collect()))
    made = list(knn.query_chunks(asked, "query_id", 40, 8))
    assert len(made) > 3 and sorted(i for m in made for i in m["query_id"]) == list(range(40))
    monkeypatch.setattr(knn, "query_chunks", lambda rows, key, count, chunk: iter(made))
    assert sorted(map(tuple, knn_batch(rows, asked, 3).collect())) == whole


def test_indexes_stand_for_each_other(spark, tmp_path):
    from tidegrid.operators import index

    rng = np.random.default_rng(6)
    rows = B.sequence(B.assign(vecs(spark, [(i, v, i) for i, v in enumerate(rng.normal(size=(240, 6)))]), 120))
    asked = queries(spark, *rng.normal(size=(8, 6)))
    c = CollectionConfig(dim=6, m=8, m_max0=16, ef_construction=64)
    for metric in ("l2sq", "cosine", "neg_dot"):
        truth, graph = index.ExactIndex(metric), index.GraphIndex(c, str(tmp_path / metric), 120, metric)
        for one in (truth, graph):
            one.build(rows)
        found = E.recall_per_query(truth.search(asked, 10), graph.search(asked, 10)).agg(F.avg("recall")).first()[0]
        assert found >= 0.9, metric
    cells = index.CellIndex(6, 6)
    truth = index.ExactIndex()
    for one in (truth, cells):
        one.build(rows)
    columns = ["query_id", "rank", "vector_id", "distance"]
    assert sorted(map(tuple, cells.search(asked, 5).select(columns).collect())) == sorted(map(tuple, truth.search(asked, 5).select(columns).collect()))
    with pytest.raises(InvalidArgument):
        hnsw.Graph(c, "manhattan")


def test_truth_cache_and_series(spark, tmp_path):
    rows = vecs(spark, [(i, [i, 0], i) for i in range(30)])
    asked = queries(spark, [3.2, 0], [20.1, 0])
    path = str(tmp_path / "truth.bin")
    ids = E.ground_truth(rows, asked, 3, path)
    assert ids.tolist() == [[3, 4, 2], [20, 21, 19]] and (E.ground_truth(rows.limit(30), asked, 3, path) == ids).all()
    (tmp_path / "truth.bin").write_bytes(E.truth_bytes(np.full((2, 3), 7), 30))
    assert (E.ground_truth(rows, asked, 3, path) == 7).all() and E.ground_truth(rows.where("vector_id < 29"), asked, 3, path).tolist() == ids.tolist()
    series = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 7.0)], "n int, rss double")
    assert tuple(E.series_summary(series, "n", "rss").first()) == (5.0, 7.0, 5.0, 9.0, 2.0)
    now, most = E.resident_bytes()
    assert 0 < now <= most
