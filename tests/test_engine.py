"""Collections end to end: tiers, snapshots, recovery, streaming, file sources."""

import numpy as np
import pytest

from tidegrid.errors import AlreadyExists, FailedPrecondition, Internal, InvalidArgument, NotFound
from tidegrid.operators import buckets as B
from tidegrid.plans.engine import Engine
from tidegrid.sources import vecs as S
from tidegrid.sources import wal
from tidegrid.streaming.ingest import ingest
from tidegrid.types import CollectionConfig

RNG = np.random.default_rng(11)
#: (id, vector, ts): two buckets of 100 seconds
ROWS = [(3 * k + 1, RNG.integers(-40, 40, 4) / 8, 17 * k) for k in range(12)]
FIRST = sum(ts < 100 for _, _, ts in ROWS)
ASKED = [(RNG.integers(-40, 40, 4) / 8, k, span) for k, span in ((3, None), (5, None), (1, None), (2, (0, 100)), (2, (100, 200)), (4, (50, 150)), (12, None))]


def nearest(data, query, k, span=None):
    """Ids by brute force; a range selects whole buckets, ties go to the older bucket, then the smaller id."""
    found = [(float(((np.asarray(v) - query) ** 2).sum()), ts // 100, i) for i, v, ts in data if span is None or span[0] // 100 <= ts // 100 <= (span[1] - 1) // 100]
    return [i for _, _, i in sorted(found)[:k]]


CONFIG = CollectionConfig(dim=4, m=4, m_max0=8, ef_construction=64, bucket_duration_secs=100)


def rows(spark, data):
    return spark.createDataFrame([(i, t, [float(x) for x in v], k) for k, (i, v, t) in enumerate(data)], "vector_id long, ts long, vector array<float>, arrival long")


def answers(engine, name="c"):
    return [[r["vector_id"] for r in engine.search(name, [float(x) for x in q], k, *(span or (None, None))).orderBy("rank").collect()] for q, k, span in ASKED]


EXPECTED = [nearest(ROWS, *a) for a in ASKED]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), str(tmp_path / "blob"))
    e.create_collection("c", CONFIG)
    return e


def test_snapshot_restart_and_log(spark, engine, tmp_path):
    taken = engine.batch_insert("c", rows(spark, ROWS[:7]))
    assert sorted(map(tuple, taken.collect()))[0] == (0, 1) and taken.count() == 7
    assert engine.snapshot("c", min_dirty=100) == []
    assert engine.snapshot("c", min_dirty=7) == [0, 1]
    engine.batch_insert("c", rows(spark, ROWS[6:]))  # one id again
    assert engine.count("c") == 12 and answers(engine) == EXPECTED
    again = Engine(spark, str(tmp_path / "root2"), str(tmp_path / "blob"))
    report = again.recover(log_root=str(tmp_path / "root"))
    assert {r["state"] for r in report.collect()} == {"restored"}
    assert again.count("c") == 12 and answers(again) == EXPECTED
    assert again.batch_insert("c", rows(spark, ROWS)).count() == 0


def test_recovery_goes_on_after_a_broken_bucket(spark, engine, tmp_path):
    engine.batch_insert("c", rows(spark, ROWS))
    engine.snapshot("c", now=1)
    engine.files.delete(str(tmp_path / "blob/c/seq_1/snap_1"))
    again = Engine(spark, str(tmp_path / "root3"), str(tmp_path / "blob"))
    states = {r["bucket_seq"]: r["state"] for r in again.recover().collect()}
    assert states[0] == "restored" and states[1] != "restored" and again.count("c") == FIRST


def test_tiers_do_not_change_answers(spark, engine):
    engine.batch_insert("c", rows(spark, ROWS))
    assert engine.swap_bucket_in("c", 0) and answers(engine) == EXPECTED
    assert engine.swap_bucket_out("c", 0) and answers(engine) == EXPECTED
    assert engine.swap_bucket_out_to_blob("c", 0, now=5) and answers(engine) == EXPECTED
    assert engine.evict_bucket("c", 0) == (True, FIRST)
    assert [r["vector_id"] for r in engine.search("c", [1.0, 0, 0, 0], 1).collect()] == nearest(ROWS[FIRST:], np.array([1.0, 0, 0, 0]), 1)
    with pytest.raises(FailedPrecondition):
        engine.search("c", [1.0, 0, 0, 0], 1, strict=True)
    assert engine.swap_bucket_in_from_blob("c", 0) == (True, FIRST) and answers(engine) == EXPECTED
    assert not engine.swap_bucket_out("c", 9) and engine.evict_bucket("c", 9) == (False, 0)


def test_graph_search(spark, engine):
    engine.batch_insert("c", rows(spark, ROWS))
    asked = spark.createDataFrame([(k, [float(x) for x in a[0]]) for k, a in enumerate(ASKED)], "query_id long, query array<double>")
    with pytest.raises(FailedPrecondition):
        engine.search_graph("c", asked, 3)
    assert engine.build_graphs("c") == 12
    for span in ((None, None), (0, 100), (5, 5)):
        want = engine.search("c", asked, 3, *span).orderBy("query_id", "rank").collect()
        assert engine.search_graph("c", asked, 3, 20, *span).orderBy("query_id", "rank").collect() == want
    flip = B.recency("penalty", penalties={0: 1000.0})
    want = engine.search("c", asked, 2, recency=flip).orderBy("query_id", "rank").collect()
    assert engine.search_graph("c", asked, 2, 20, recency=flip).orderBy("query_id", "rank").collect() == want
    engine.evict_bucket("c", 0)
    assert {r["bucket_seq"] for r in engine.search_graph("c", asked, 3).collect()} == {1}


def test_rotation_retention_and_vacuum(spark, engine, tmp_path):
    engine.batch_insert("c", rows(spark, ROWS[:1]))
    assert engine.rotate_bucket("c", 100) == 1 and engine.rotate_bucket("c", 205) == 1
    assert [b["start"] for b in engine.bucket_metas("c")] == [200, 0]
    engine.batch_insert("c", rows(spark, [(50, [0, 0, 0, 0], 40)]))  # late: to the newest bucket
    assert [b["rows"] for b in engine.bucket_metas("c")] == [1, 1]
    engine.snapshot("c", now=1)
    engine.batch_insert("c", rows(spark, [(51, [0, 0, 0, 0], 210)]))
    engine.snapshot("c", now=2)
    assert engine.evict_before("c", 200) == 1 and engine.count("c") == 2
    gone = engine.vacuum("c")
    assert sorted(g.split("/c/")[1] for g in gone) == ["seq_0", "seq_1/snap_1"]
    assert engine.batch_insert("c", rows(spark, ROWS[:1])).count() == 0  # evicted ids stay known
    assert engine.evict_oldest("c") == 1 and engine.evict_oldest("c") is None


def test_errors(spark, engine, tmp_path):
    for f, kind in (
        (lambda: engine.search("x", [1.0] * 4, 1), NotFound),
        (lambda: engine.batch_insert("x", rows(spark, ROWS)), NotFound),
        (lambda: engine.create_collection("c", CONFIG), AlreadyExists),
        (lambda: engine.create_collection("", CONFIG), InvalidArgument),
        (lambda: engine.create_collection("d", CollectionConfig(0)), InvalidArgument),
        (lambda: engine.create_collection("d", CollectionConfig(4, m=1)), InvalidArgument),
        (lambda: engine.create_collection("d", CollectionConfig(4, m=8, m_max0=4)), InvalidArgument),
        (lambda: engine.create_collection("d", CollectionConfig(4, ef_construction=2)), InvalidArgument),
        (lambda: engine.batch_insert("c", rows(spark, [(1, [1.0], 0)])), InvalidArgument),
        (lambda: engine.search("c", [], 1), InvalidArgument),
        (lambda: engine.search("c", [1.0] * 4, 0), InvalidArgument),
        (lambda: engine.search("c", [1.0] * 3, 1), InvalidArgument),
        (lambda: Engine(spark, str(tmp_path)).snapshot("c"), FailedPrecondition),
    ):
        with pytest.raises(kind):
            f()
    assert engine.batch_insert("x", rows(spark, ROWS).limit(0)).count() == 0
    assert engine.batch_insert("c", rows(spark, [(1, [1.0] * 4, 0)])).count() == 1  # a rejected batch leaves nothing behind


def test_endless_bucket(spark, engine):
    engine.create_collection("one", CollectionConfig(4))
    engine.batch_insert("one", rows(spark, ROWS))
    assert [b["start"] for b in engine.bucket_metas("one")] == [0] and answers(engine, "one")[0] == EXPECTED[0]


def test_streaming_equals_batch(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, ROWS[:6]).coalesce(1).write.parquet(source)
    rows(spark, ROWS[4:]).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema("vector_id long, ts long, vector array<float>").parquet(source)
        q = ingest(stream, engine, "c", str(tmp_path / "checkpoint"))
        assert q.awaitTermination(120)
    assert engine.count("c") == 12
    assert sorted(r[0] for r in engine.stored("c").select("vector_id").collect()) == [t[0] for t in ROWS]


def test_vector_files(spark, tmp_path):
    S.register(spark)
    values = (np.arange(60).reshape(20, 3) * 0.001).astype("<f4")
    raw = b"".join(np.int32(3).tobytes() + v.tobytes() for v in values)
    (tmp_path / "a.fvecs").write_bytes(raw + np.int32(9).tobytes())  # a cut-off record
    read = spark.read.format("fvecs").option("records_per_partition", 7).load(str(tmp_path / "a.fvecs"))
    got = read.orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(20)) and np.allclose([r["values"] for r in got], values)
    assert spark.read.format("fvecs").option("limit", 5).load(str(tmp_path / "a.fvecs")).count() == 5
    assert spark.read.format("fvecs").option("dim", 4).load(str(tmp_path / "a.fvecs")).count() == 0
    read.select("row_id", "values").write.format("fvecs").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("fvecs").load(str(tmp_path / "out")).count() == 20
    (tmp_path / "b.ivecs").write_bytes(b"".join(np.array([2, k, k + 1], "<i4").tobytes() for k in range(4)))
    assert [r["values"] for r in spark.read.format("ivecs").load(str(tmp_path / "b.ivecs")).orderBy("row_id").collect()] == [[k, k + 1] for k in range(4)]


def test_log_codec(spark, tmp_path):
    raw = wal.encode(3, [([1.0, 2.0, 3.0, 4.0], 50, 11)])
    assert len(raw) == 52 and wal.decode(raw) == (3, [([1.0, 2.0, 3.0, 4.0], 50, 11)])
    assert wal.decode(wal.encode(1, [])) == (1, [])
    for bad in (raw[:-1], raw[:20] + b"x" + raw[21:], b""):
        with pytest.raises(Internal):
            wal.decode(bad)
    for seq in (1, 2, 12):
        (tmp_path / f"{seq:020}.wal").write_bytes(wal.encode(seq, [([float(seq)], seq, seq * 10), ([0.5], seq, seq * 10 + 1)]))
    got = wal.read(spark, str(tmp_path), after=1).orderBy("seq", "position").collect()
    assert [(r["seq"], r["vector_id"]) for r in got] == [(2, 20), (2, 21), (12, 120), (12, 121)]
    (tmp_path / "log.txt").write_text("n=10 rss=5.5\nnoise\nn=20 rss=6\n")
    assert [tuple(r) for r in wal.parse_log(spark, str(tmp_path / "log.txt"), r"n=(\d+) rss=([\d.]+)", ["n", "rss"]).collect()] == [(10.0, 5.5), (20.0, 6.0)]


def ids(engine, name="c"):
    return sorted(r[0] for r in engine.stored(name).select("vector_id").collect())


def places(engine, name="c"):
    return {r["vector_id"]: (r["bucket_seq"], r["bucket_start"]) for r in engine.stored(name).collect()}


def test_in_place_recovery_keeps_every_entry(spark, engine):
    for k in range(0, 12, 4):
        engine.batch_insert("c", rows(spark, ROWS[k : k + 4]))
    before = places(engine)
    assert {r["state"] for r in engine.recover().collect()} == {"kept"} and ids(engine) == [r[0] for r in ROWS]
    for _ in range(2):
        engine.recover(replace=True)
        assert places(engine) == before and answers(engine) == EXPECTED
    engine.snapshot("c")
    assert engine.files.list(f"{engine.root}/c/wal") == []
    engine.recover(replace=True)
    assert places(engine) == before and engine.dirty("c") == {0: 0, 1: 0}


def test_sealed_buckets_lose_nothing(spark, engine, tmp_path):
    engine.batch_insert("c", rows(spark, ROWS[:3]))
    assert engine.swap_bucket_out_to_blob("c", 0)
    engine.batch_insert("c", rows(spark, ROWS[3:5]))  # the same start, another bucket
    assert [(b["seq"], b["start"], b["rows"]) for b in engine.bucket_metas("c")] == [(1, 0, 2), (0, 0, 3)]
    assert engine.snapshot("c") == [1]
    again = Engine(spark, str(tmp_path / "elsewhere"), engine.blob)
    again.recover()
    assert ids(again) == ids(engine) == [r[0] for r in ROWS[:5]]
    engine.batch_insert("c", rows(spark, [(99, [0] * 4, 60)]))
    with pytest.raises(FailedPrecondition):
        engine.swap_bucket_in_from_blob("c", 1)  # its snapshot lacks a row
    assert engine.swap_bucket_in_from_blob("c", 0) == (True, 3) and 99 in ids(engine)
    assert engine.evict_bucket("c", 1) == (True, 3) and not [p for p in engine._get("c")["buckets"]["1"]["files"] if p.startswith(engine.root)]
    assert engine.swap_bucket_in_from_blob("c", 1) == (True, 3) and 99 in ids(engine)
    assert engine.batch_insert("c", rows(spark, ROWS[:5])).count() == 0


def test_recovery_keeps_routes_rotations_and_dropped_ids(spark, engine, tmp_path):
    engine.batch_insert("c", rows(spark, [(1, [1] * 4, 500), (2, [2] * 4, 20)]), mode="event_time")
    engine.rotate_bucket("c", 900)
    engine.batch_insert("c", rows(spark, [(3, [3] * 4, 30)]))  # late: to the newest
    before = places(engine)
    assert before == {2: (0, 0), 1: (1, 500), 3: (2, 900)}
    again = Engine(spark, str(tmp_path / "elsewhere"), engine.blob)
    again.recover(log_root=engine.root)
    assert places(again) == before
    engine.snapshot("c")
    engine.evict_oldest("c")
    engine.rotate_bucket("c", 1200)
    third = Engine(spark, str(tmp_path / "third"), engine.blob)
    third.recover(log_root=engine.root)
    assert places(third) == {1: (1, 500), 3: (2, 900)} and [b["start"] for b in third.bucket_metas("c")] == [1200, 900, 500]
    assert third.batch_insert("c", rows(spark, [(2, [2] * 4, 20)])).count() == 0  # a dropped id stays known elsewhere


def test_log_mark_waits_for_every_bucket(spark, engine, monkeypatch):
    engine.batch_insert("c", rows(spark, ROWS))
    write = Engine._write_snapshot

    def broken(self, name, b, now):
        if b["seq"] == 1:
            raise OSError("store away")
        return write(self, name, b, now)

    monkeypatch.setattr(Engine, "_write_snapshot", broken)
    with pytest.raises(OSError, match="store away"):
        engine.snapshot("c")
    assert len(engine.files.list(f"{engine.root}/c/wal")) == 1 and engine.dirty("c") == {0: 0, 1: 12 - FIRST}
    engine.recover(replace=True)
    assert ids(engine) == [r[0] for r in ROWS] and engine.dirty("c") == {0: 0, 1: 12 - FIRST}
    monkeypatch.undo()
    assert engine.snapshot("c") == [1] and engine.files.list(f"{engine.root}/c/wal") == []


def test_rows_that_come_during_a_snapshot_stay_dirty(spark, engine, monkeypatch):
    engine.batch_insert("c", rows(spark, ROWS[:2]))
    write = Engine._write_snapshot

    def slow(self, name, b, now):
        made = write(self, name, b, now)
        engine.batch_insert("c", rows(spark, ROWS[2:4]))
        return made

    monkeypatch.setattr(Engine, "_write_snapshot", slow)
    assert engine.snapshot("c") == [0]
    monkeypatch.undo()
    assert engine.dirty("c") == {0: 2} and len(engine.files.list(f"{engine.root}/c/wal")) == 1
    engine.recover(replace=True)
    assert ids(engine) == [r[0] for r in ROWS[:4]]


class Crash(Exception):
    pass


def test_a_crash_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    from tidegrid.plans.files import Files

    write, delete, left = Files.write_json, Files.delete, [10**9]

    def counted(f):
        def run(*args, **more):
            left[0] -= 1
            if left[0] < 0:
                raise Crash
            return f(*args, **more)

        return run

    monkeypatch.setattr(Files, "write_json", counted(write))
    monkeypatch.setattr(Files, "delete", counted(delete))
    crashes = 0
    for at in range(0, 60, 3):
        left[0] = 10**9
        e = Engine(spark, str(tmp_path / f"root{at}"), str(tmp_path / f"blob{at}"))
        e.create_collection("c", CONFIG)
        acked, sent = [], [r[0] for r in ROWS[:9]]
        left[0] = at
        try:
            for k in (0, 6):
                e.batch_insert("c", rows(spark, ROWS[k : k + 3]))
                acked += [r[0] for r in ROWS[k : k + 3]]
                if k == 0:
                    e.snapshot("c")
                    e.swap_bucket_out_to_blob("c", 0)
            e.snapshot("c")
            done = True
        except Crash:
            done, crashes = False, crashes + 1
        left[0] = 10**9
        back = Engine(spark, e.root, e.blob)
        for replace in (False, True):
            back.recover(replace=replace)
            found = ids(back)
            assert len(found) == len(set(found)) and set(acked) <= set(found) <= set(sent), at
        if done:
            break
    assert crashes > 5 and done


def test_writers_that_come_between_do_not_lose_updates(spark, engine):
    other = Engine(spark, engine.root, engine.blob)
    place, turns = Engine._place, [1]

    def interrupted(self, name, state, routed, entry):
        made = place(self, name, state, routed, entry)
        if turns[0]:
            turns[0] = 0
            other.batch_insert("c", rows(spark, ROWS[2:6]))
        return made

    engine._place = interrupted.__get__(engine)
    assert engine.batch_insert("c", rows(spark, ROWS[:4])).count() == 2  # the other one was first with two of these
    assert ids(engine) == [r[0] for r in ROWS[:6]] and engine.count("c") == 6


def test_reset_and_drop(spark, engine):
    engine.batch_insert("c", rows(spark, ROWS))
    engine.snapshot("c")
    assert not engine.is_empty("c") and engine.has_bucket("c", 1) and engine.bucket_created_at("c", 1) == 100
    engine.reset_collection("c")
    assert engine.is_empty("c") and not engine.has_bucket("c", 1) and engine.batch_insert("c", rows(spark, ROWS)).count() == 12
    engine.recover(replace=True)
    assert engine.count("c") == 12 and answers(engine) == EXPECTED
    assert engine.bucket_tier("c", 2) == "hot" and engine.all_in_tier("c", "hot") and not engine.all_in_tier("c", "evicted")
    engine.drop_collection("c")
    assert engine.collections() == [] and engine.recover().count() == 0
    engine.create_collection("c", CONFIG)
    assert engine.count("c") == 0


def test_a_manifest_of_another_format_is_refused(engine):
    engine.files.write_json(f"{engine.root}/c/manifest", {"version": 2})
    with pytest.raises(Internal):
        engine.count("c")


def test_clean_up_one_cycle_later(spark, engine):
    engine.batch_insert("c", rows(spark, ROWS[:2]))
    engine.snapshot("c", now=1)
    engine.batch_insert("c", rows(spark, ROWS[2:4]))
    engine.snapshot("c", now=2)
    assert engine.vacuum("c", delay=True) == []
    assert [p.split("/c/")[1] for p in engine.vacuum("c", delay=True)] == ["seq_0/snap_1"]
    engine.evict_oldest("c")
    assert engine.vacuum_local("c") and engine.count("c") == 0


def test_replay_of_binary_log_files(spark, engine, tmp_path):
    for seq in range(4):
        item = [([float(seq)] * 4, 10 * seq, 2 * seq), ([0.5] * 4, 10 * seq, 2 * seq + 1)]
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{seq:020}.wal").write_bytes(wal.encode(seq, item))
    assert engine.replay_log("c", str(tmp_path / "log"), after=1).count() == 4
    assert ids(engine) == [4, 5, 6, 7] and engine.replay_log("c", str(tmp_path / "log")).count() == 4
