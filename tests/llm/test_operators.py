"""The operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import chat, common, decontaminate, jaccard, lines, pack, passages, pii, textkernels, toxicity, vptree
from tidegrid.llm.common import connected_components

DOCS = "doc_id long, text string, n long, score double, key string, a long, comp long, margin double, _gone int"


def docs(spark, rows):
    """A table whose extra columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, 1, 0.5, "k", 2, 3, 4.0, 5) for i, t in rows], DOCS)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \t\n "), (903, "x"), (904, "é" * 3), (905, "a " * 4000)]


def test_word_kernels():
    texts = ["The  cat\tSAT", None, "", "  ", "ÉTÉ a\x0bb", "z" * 5000, "the cat"]
    data, offsets = textkernels.buffers(pa.array(texts))
    starts, ends, first = textkernels.words(data, offsets)
    got = [[bytes(data[s:e]) for s, e in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert got == [[w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w] for t in texts]
    h = textkernels.span_hashes(data, starts, ends)
    assert h[0] == h[first[6]] and h[1] == h[first[6] + 1] and len(set(h.tolist())) == 7
    value, begin = textkernels.shingles(h, first, 3)
    assert np.diff(begin).tolist() == [1, 0, 0, 0, 1, 1, 1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 102), (200, 200)] + [(300, k) for k in range(301, 340)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {r["id"]: r["component"] for r in connected_components(edges, local_edges=0).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 102: 100, 103: 100} | {300: 300} | {k: 300 for k in range(301, 340)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_workers_give_memory_back(spark, monkeypatch):
    """The pipeline's workers stay for later stages, so each task ends by giving memory back."""
    trims, works, table = [], [], docs(spark, [])
    monkeypatch.setattr(common, "trim", lambda: trims.append(1))
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, work, schema: works.append(work) or spark.createDataFrame([], schema))
    jaccard.sketch(table, 5, 80)
    pack.pack(table, "none")
    assert len(works) == 3
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": [prose(1, 60), None]})
    assert [b.num_rows for b in works[0](iter([batch]))] == [2] and trims == [1]
    assert list(works[2](iter([]))) == [] and trims == [1, 1]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, percent):
    r, rows = random.Random(3), list(ODD)
    for g in range(12):
        base = prose(g, r.choice([1, 2, 4, 12, 40, 150, 700])).split()
        for k in range(6):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = f"new{r.randrange(9)}"
            rows.append((g * 10 + k, " ".join(w).upper() if k == 5 else " ".join(w)))
    rows += [(7, rows[-1][1]), rows[8], (None, "no id")]

    def shingle_set(t):
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    known = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in known}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, x), (j, y) in itertools.combinations(known, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = jaccard.components(docs(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    unique = {i for i, n in Counter(i for i, _ in known).items() if n == 1}
    for x in got:
        if x["doc_id"] in unique:
            assert x["component_id"] == find(x["doc_id"]) and x["n_shingles"] == len(dict(known)[x["doc_id"]])
        elif x["doc_id"] is None:
            assert x["component_id"] is None
    assert jaccard.components(docs(spark, []), size, percent).count() == 0


def test_tiles_of_many_components_are_compared_block_by_block(spark, monkeypatch):
    rng, n = random.Random(5), 150
    base = set(range(1000, 1040))
    sets = {i: np.array(sorted(base | {i}), np.uint64) for i in range(n)}
    rows = [(1, i, i, 0, n, len(s), jaccard.bitmap(s)) for i, s in sets.items()]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "sig long, rep long, comp long, leader long, c long, n long, bitmap binary")
    from tidegrid.shipping import ship

    ship(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    assert jaccard.tile_pairs(made, 80).count() == (n - 1) * (n - 2) // 2  # all but the leader's


def brute_lines(rows, least=20):
    found, out = [], set()
    for i, t in sorted((x for x in set(rows) if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
        for k, line in enumerate(t.split("\n")):
            if len(line) >= least:
                found.append((i, k, line))
    for n, (i, k, line) in enumerate(found):
        same = next(((a, b) for a, b, other in found[:n] if other == line), None)
        if same:
            out.add((i, k, *same, 0))
            continue
        for a, b, other in found[:n]:
            if within_one(line, other):
                out.add((i, k, a, b, 1))
                break
    return out


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]


def test_line_dedup(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcé𝒳 ") for _ in range(r.choice([5, 19, 20, 21, 40, 90]))) for _ in range(14)] + ["a" * 30, "ab" * 15]

    def edit(x):
        k = r.randrange(len(x))
        return r.choice([x, x, x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "q" + x[k + 1 :], x[:k] + "qq" + x[k:]])

    rows = [(i, "\n".join(edit(r.choice(base)) for _ in range(r.randrange(1, 9)))) for i in range(40)]
    rows += ODD + [(None, base[3]), (906, "\n" * 50 + "z" * 4000), (907, "z" * 4001), rows[0]]
    got = {tuple(x) for x in lines.duplicate_lines(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert {x for x in got if x[4] == 0} == {tuple(x) for x in lines.duplicate_lines(docs(spark, rows), max_edits=0).collect()}
    drops = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 1, 0, 0, 0)], "doc_id long, line_no int, keeper_doc_id long, keeper_line_no int, distance int")
    table = spark.createDataFrame([(1, "gone", 4), (2, "a\nb\nc", 5), (3, None, 0), (4, "", 0), (None, "a", 1)], "doc_id long, text string, n_chars long")
    assert {tuple(x) for x in lines.drop_lines(table, drops).collect()} == {(2, "a\nc", 3), (3, None, 0), (4, "", 0), (None, "a", 1)}
    assert lines.duplicate_lines(docs(spark, [])).count() == 0


def test_dropping_lines_of_clashing_tables(spark):
    names = ["_id", "_gone", "line_no", "gone", "id", "row", "Gone", "lines", "a.b"]
    rows = [(1, "x" * 30 + "\nown line", 38), (2, "x" * 30 + "\nsecond", 37), (2, "quite another line of text\nthird", 32), (3, None, 0), (2, None, 0), (None, "x" * 30, 30)]
    table = spark.createDataFrame([(*x, *[f"{n}{k}" for n in names]) for k, x in enumerate(rows)], ["doc_id", "text", "n_chars", *names])
    table = table.drop("Gone").withColumnRenamed("row", "GONE_")
    got = lines.drop_lines(table, lines.duplicate_lines(table, line_hash=True))
    assert got.columns == table.columns
    found = {(x["doc_id"], x["text"], x["n_chars"]): x for x in got.collect()}
    # the other text of document 2 has another line at that number, and keeps it
    assert set(found) == {(1, "x" * 30 + "\nown line", 38), (2, "second", 6), (2, "quite another line of text\nthird", 32), (3, None, 0), (2, None, 0), (None, "x" * 30, 30)}
    assert found[2, "second", 6]["_id"] == "_id1" and found[2, "second", 6]["a.b"] == "a.b1"


def test_decontamination(spark):
    items = [(1, prose("i1", 30)), (2, prose("i2", 15)), (3, None), (4, ""), (5, "short one"), (6, prose("i1", 30)), (None, prose("n", 30))]
    one = items[0][1].split()
    changed = one[:]
    changed[4], changed[11], changed[19] = "x", "y", "z"
    rows = [
        (1, prose(1, 50) + " " + " ".join(one) + " " + prose(2, 9)),
        (2, prose(3, 20) + " " + " ".join(changed).upper()),
        (3, " ".join(one[5:20])),
        (4, " ".join(one[5:11]) + " " + prose(4, 80)),
        (5, prose(5, 200)),
        (6, items[1][1].replace(" ", ", ") + "."),
        *ODD,
        (None, items[0][1]),
        (1, prose(6, 30)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (1, 6), (2, 1), (2, 6), (3, 1), (3, 6), (6, 2)}
    assert (got[1, 1]["doc_start"], got[1, 1]["length"], got[1, 1]["matches"]) == (50, 30, 30)
    assert (got[2, 1]["length"], got[2, 1]["matches"], got[2, 1]["score"]) == (30, 27, 24)
    assert (got[3, 1]["item_start"], got[3, 1]["length"]) == (5, 15)
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0 == decontaminate.overlaps(docs(spark, rows), bench.limit(0)).count()


def test_chat_round_trip(spark):
    hard = ["", None, r"\### Assistant: </turn> ok", "### User: hi </turn>\n", "####", "\\", "\\\\###\\</turn>", "a\nb", "</turn", "é𝒳" * 9, "x" * 50_000]
    roles = ["user", "assistant", "system", "tool: x", None]
    r = random.Random(2)
    rows = [(c, t, r.choice(roles), r.choice(hard)) for c in range(30) for t in range(r.randrange(1, 7))]
    rows += [(50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "assistant", "a"), (None, 0, "user", "x"), (51, 0, "user", "same"), (51, 0, "user", "same")]
    table = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, position int")
    got = {x["conv_id"]: x for x in chat.digests(chat.format_segments(table)).collect()}
    assert len(got) == len({x[0] for x in rows})
    for c, x in got.items():
        own = sorted(((t, role or "", text or "") for cc, t, role, text in rows if cc == c))
        joined = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert x["n_turns"] == len(own) and x["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert x["loss_chars"] == len(loss) and x["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[50]["valid"] and not got[None]["valid"] and not got[51]["valid"]
    assert chat.digests(chat.format_segments(table.limit(0))).count() == 0
    with pytest.raises(ValueError, match="could begin"):
        chat.Template(controls=("### ", "</turn>"))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, prose(i, n)) for i, n in enumerate([1, 3000, 5, 700, 700, 20, 0, 333] * 6)] + ODD + [(None, "null id"), (77, "a<|endoftext|>b"), (78, "Ünï 𝒳\r\n\t  spaces  "), (78, "x")]
    texts = docs(spark, rows).repartition(5)
    for size, windows in ((64, 4), (1024, 64)):
        got = pack.pack(texts, path, size=size, windows=windows, merge=2, least_cut=4).collect()
        by_doc = {}
        for x in got:
            by_doc.setdefault(x["doc_id"], []).append(x)
        for i in {i for i, _ in rows}:
            want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in rows if d == i]
            pieces = sorted(by_doc[i], key=lambda x: (x["doc_tokens"], x["start"]))
            assert b"".join(bytes(p["ids"]) for p in pieces) == b"".join(sorted(want, key=len))
        by_sequence = {}
        for x in got:
            assert x["length"] * 4 == len(x["ids"])
            by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        for s in by_sequence.values():
            s.sort()
            assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= size
    assert pack.pack(docs(spark, []), path).count() == 0


def brute_neighbours(base, k):
    out = {}
    for i, v in base:
        if i % 50 == 0:
            near = sorted(((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in base if j != i), key=lambda x: (round(x[0], 10), x[1]))
            out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("n", [1, 4, 700])
def test_vantage_points(spark, n):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(7, 8))
    base = [(i, (centre[i % 7] + 0.3 * rng.normal(size=8)).astype(np.float32).astype(float)) for i in range(n)]
    base = [(i, base[3][1] if n > 9 and i % 11 == 3 else v) for i, v in base]  # many copies of one vector
    odd = [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [float("nan")] * 8), (1200, [float("inf")] + [1.0] * 7), (1250, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], 1) for i, v in base + odd], "vec_id long, embedding array<float>, rank int")
    index = vptree.build_index(rows, "vec_id", "embedding", shard_rows=300)
    asked = rows.where("vec_id % 50 = 0")
    got = {}
    for x in vptree.search(index, asked, "vec_id", "embedding", 5, 1.0, block_rows=6).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    want = {q: v for q, v in brute_neighbours(base, 5).items() if v}
    assert got == want
    if n > 9:
        relaxed = {(x["query_id"], x["vec_id"]) for x in vptree.search(index, asked, "vec_id", "embedding", 5, 0.6).collect()}
        assert len(relaxed & {(q, j) for q, v in want.items() for j in v}) >= 0.5 * sum(map(len, want.values()))
        one = vptree.search(index, asked.where("vec_id = 50"), "vec_id", "embedding", 5)
        assert [x["vec_id"] for x in one.orderBy("rank").collect()] == want[50]


def test_vantage_points_with_many_ties(spark):
    """Scaled copies of one vector: their cosines differ in the last bits alone, and these decide."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=16).astype(np.float32)
    base = [(i, (one * np.float32(1 + rng.random())).astype(np.float32).astype(float)) for i in range(2000)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in base], "vec_id long, embedding array<double>")
    got = [(x["vec_id"], x["score"]) for x in vptree.search(vptree.build_index(rows, "vec_id", "embedding"), rows.where("vec_id = 50"), "vec_id", "embedding").orderBy("rank").collect()]
    table = np.stack([v for _, v in base])
    score = vptree.cosine(np.broadcast_to(table[50], table.shape), table)
    assert got == [(int(i), score[i]) for i in np.lexsort((np.arange(2000), -score)) if i != 50][:5]


def test_vantage_points_relaxed(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 16))
    base = [(i, (centre[i % 20] + 0.5 * rng.normal(size=16)).tolist()) for i in range(4000)]
    rows = spark.createDataFrame(base, "vec_id long, embedding array<double>")
    index, asked = vptree.build_index(rows, "vec_id", "embedding", shard_rows=1500), rows.where("vec_id % 100 = 0")
    exact = {(x["query_id"], x["vec_id"]) for x in vptree.search(index, asked, "vec_id", "embedding", 5).collect()}
    assert exact == {(q, j) for q, near in brute_neighbours(base, 5).items() if q % 100 == 0 for j in near}
    for factor in (0.95, 0.9):
        found = {(x["query_id"], x["vec_id"]) for x in vptree.search(index, asked, "vec_id", "embedding", 5, factor).collect()}
        assert len(found & exact) >= 0.9 * len(exact), factor


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def passes(kind, m):
    g = re.sub("[^0-9]", "", m)
    if kind == 1:
        return all(int(p) <= 255 for p in m.split("."))
    if kind == 2:
        return 12 <= len(g) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(g))) % 10 == 0
    return kind == 0 or 9 <= len(g) <= 15


def test_pii(spark):
    r = random.Random(6)
    bits = ["a.b_c@x.com", "@", ".", "+", "1.2.3.4", "300.1.1.1", "007.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (999) 555-0199", "+44", " ", "é𝒳", "-", "5", "(", ")", "x@y", "a@b.c.d@e.f", "%", "00000000000000"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))) for i in range(300)]
    rows += ODD + [(906, "1" * 30_000), (907, "a" * 15_000), (908, "+1" + "(" * 30_000), (909, "a@" + "b." * 9_000 + "c"), (910, "1-" * 30_000), (906, "+1 (999) 555-0199")]
    rows += [(1000 + i, f"please call our phone line {200 + i} 555 0{100 + i} today or mail bob (at) example (dot) com") for i in range(30)]
    rows += [(2000 + i, f"mail to bob{i}@mail.example.com or phone +1 (200) 555-0{100 + i}, ip 10.0.0.{i}") for i in range(30)]
    got = pii.find(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i, sorted((m.start(), k, m.end()) for k in range(4) for m in re.finditer(PLAIN[k], t or "") if passes(k, m[0]))) for i, t in rows)
    assert sorted((x["doc_id"], [tuple(s) for s in x["base"]]) for x in got) == want
    added = {x["doc_id"]: x["added"] for x in got}
    assert all(len(added[1000 + i]) >= 1 for i in range(30)) and not any(added[2000 + i] for i in range(30))
    for x in got:
        spans = sorted([tuple(s) for s in x["added"]])
        assert all(b[0] >= a[2] for a, b in zip(spans, spans[1:], strict=False))
        assert not any(a[0] < b["end"] and b["start"] < a[2] for a in spans for b in x["base"])
    assert pii.find(docs(spark, [])).count() == 0


def test_labeler_reliability():
    counts = [(0, (1, 1, 1), 60), (0, (1, 0, 1), 20), (0, (-1, -1, 0), 50), (0, (-1, 0, -1), 25), (0, (0, 1, 1), 9), (0, (0, -1, -1), 9)]
    p = pii.estimate(counts)
    assert p[0, (0, 1, 1)] > 0.9 > 0.1 > p[0, (0, -1, -1)]


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(80):
        n, least = int(rng.integers(1, 60)), int(rng.integers(2, 9))
        values = np.concatenate(([0], rng.permutation(np.arange(1, n + 1)), [0], rng.permutation(np.arange(1, 20))[: rng.integers(0, 19)], [0])).astype(np.uint64)
        want = set()

        def cut(a, b, values=values, least=least, want=want):
            if b - a + 1 >= least:
                c = a + int(np.argmin(values[a : b + 1]))
                want.add((a, c, b))
                cut(a, c - 1)
                cut(c + 1, b)

        zero = np.flatnonzero(values == 0)
        for a, b in zip(zero, zero[1:], strict=False):
            cut(int(a) + 1, int(b) - 1)
        assert set(zip(*(v.tolist() for v in passages.compact_windows(values, least)), strict=True)) == want


def test_passages(spark):
    shared, near = prose("s", 80), prose("n", 120).split()
    varied = near[:]
    varied[30], varied[90] = "q", "q"
    rows = [
        (1, prose(1, 300) + " " + shared + " " + prose(2, 100)),
        (2, shared.upper() + " " + prose(3, 60)),
        (3, prose(4, 40) + "\n" + shared),
        (4, " ".join(near)),
        (5, prose(5, 70) + " " + " ".join(varied)),
        (6, prose(6, 400)),
        (7, " ".join(shared.split()[:45]) + " " + prose(7, 100)),
        (8, "ha " * 900),
        (9, "ha " * 300),
        *ODD,
        (None, shared),
        (6, prose(8, 60)),
    ]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    pairs = {(x["doc_id"], x["source_doc_id"]) for x in got}
    assert {(2, 1), (3, 1), (5, 4), (9, 8)} <= pairs and not {d for d, _ in pairs} & {1, 4, 6, 7}
    best = {(x["doc_id"], x["source_doc_id"]): x for x in got}
    assert (best[2, 1]["start"], best[2, 1]["end"], best[2, 1]["source_start"]) == (0, 80, 300) and best[2, 1]["similarity"] == 1
    assert (best[5, 4]["start"], best[5, 4]["end"]) == (70, 190) and 0.8 <= best[5, 4]["similarity"] < 1
    assert passages.repeated_passages(docs(spark, [])).count() == 0


def test_passages_of_hot_lines(spark):
    rows, want = [], set()
    for g in range(12):
        hot = [prose(f"hot{g} {k}", 20) for k in range(3)]
        rows += [(10 * g + i, "\n".join(prose(f"{g} {i} {k}", 30) + "\n" + hot[(i + 2 * k) % 3] for k in range(3)) + "\n" + prose(f"end {g} {i}", 30)) for i in range(6)]
        whole, at = " ".join(hot), 1000 + 2 * g
        rows += [(at, prose(f"{g} a", 40) + " " + whole + " " + prose(f"{g} b", 40)), (at + 1, prose(f"{g} c", 50) + " " + whole + " " + prose(f"{g} d", 50))]
        want.add((at + 1, at, 50, 110, 40, 100))
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert want <= {(x["doc_id"], x["source_doc_id"], x["start"], x["end"], x["source_start"], x["source_end"]) for x in got}
    assert {(x["doc_id"], x["source_doc_id"]) for x in got} == {x[:2] for x in want}


def test_passages_with_earlier_loose_lines(spark):
    shared = prose("once", 60)
    w = shared.split()
    loose = "\n".join(" ".join(w[k : k + 5]) + " " + prose(400 + k, 60) for k in range(len(w) - 4))
    rows = [(1, loose + "\n" + shared + "\n" + prose(500, 60)), (2, prose(501, 60) + "\n" + shared)]
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert [(x["doc_id"], x["source_doc_id"], x["start"], x["end"]) for x in got] == [(2, 1, 60, 120)]


def kernel(a, b):
    def count(u):
        out = {}
        for i, d, e in itertools.product(range(len(u)), (1, 2, 3), (1, 2, 3)):
            if i + d + e < len(u):
                key = (u[i], u[i + d], u[i + d + e])
                out[key] = out.get(key, 0) + 0.5 ** (d + e - 2)
        return out

    x, y = count(a), count(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_string_kernel():
    units = [b"?idiot", b"?idxiot", b"?the", b"?i"]
    units = [bytes([63, *(c - 96 for c in u[1:])]) for u in units]
    weights, _ = np.zeros(1 << 18), None
    flat, where = toxicity._flat([units[0]])
    for _, sub, weight in toxicity.triples(flat, where):
        np.add.at(weights, sub, weight)
    model = toxicity.Model(weights, 0.0, 1.0, 0.0)
    flat, where = toxicity._flat(units)
    got = model.margins(flat, where) * toxicity.norms(where)
    assert got == pytest.approx([kernel(units[0], u) for u in units])
    starts = toxicity.units(*textkernels.buffers(pa.array(["i d i o t x yy a b", "a", "a b c"])))
    assert [(int(s), int(e)) for s, e in zip(starts[0], starts[1], strict=True) if e - s > 2] == [(0, 11), (19, 24)]


def shingle_table(rows):
    """Per document the numbers of its five-word shingles, in order."""
    numbers = {}
    return {i: np.array([numbers.setdefault(tuple(w[k : k + 5]), len(numbers)) for k in range(len(w) - 4)], int) for i, t in rows if len(w := t.lower().split()) >= 50}


def alike_windows(x, y, least=46):
    """Per stretch of ``least`` shingles of x whether y has one whose set is alike by 0.8, both from a common shingle to another, and whether it has the same."""
    if min(len(x), len(y)) < least:
        return np.zeros(max(0, len(x) - least + 1), bool), np.zeros(max(0, len(x) - least + 1), bool)
    same = np.pad((x[:, None] == y[None, :]).astype(np.int32), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    both = same[least:, least:] - same[:-least, least:] - same[least:, :-least] + same[:-least, :-least]  # shingles are distinct within a text here
    runs = {tuple(y[k : k + least].tolist()) for k in range(len(y) - least + 1)}
    u, v = np.isin(x, y), np.isin(y, x)
    u, v = u[: len(x) - least + 1] & u[least - 1 :], v[: len(y) - least + 1] & v[least - 1 :]
    return ((both * 10 >= 8 * (2 * least - both)) & u[:, None] & v[None, :]).any(axis=1), np.array([tuple(x[k : k + least].tolist()) in runs for k in range(len(x) - least + 1)])


def passage_corpus(seed):
    """Texts with frequent lines, passages of such lines, near copies of several kinds, and halves that earlier documents hold."""
    r, rows = random.Random(seed), []
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    hot = [fresh(20) for _ in range(6)]
    for _ in range(40):  # each frequent line in other surroundings
        rows.append(sum((fresh(r.randrange(20, 40)) + line for line in r.sample(hot, 3)), []) + fresh(25))
    for _ in range(12):
        lines = r.sample(hot, 3)
        passage = sum(lines, [])
        for _ in range(3):
            copy = passage[:]
            for _ in range(r.choice([0, 0, 1])):
                copy[r.randrange(len(copy))] = fresh(1)[0]
            rows.append(fresh(r.randrange(60)) + copy + fresh(r.randrange(60)))
    for _ in range(30):
        passage = fresh(r.randrange(52, 100))
        half = len(passage) // 2
        for k in range(r.choice([0, 6])):
            part = passage[:half] if k % 2 else passage[half:]
            rows.append(fresh(r.randrange(30, 60)) + part + fresh(r.randrange(30, 60)))
        for _ in range(r.randrange(2, 5)):
            copy = passage[:]
            for _ in range(r.choice([0, 1, 2])):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([fresh(1), [], fresh(2)])
            rows.append(fresh(r.randrange(60)) + copy + fresh(r.randrange(60)))
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_all_pairs(spark, seed):
    """Every exact repeat is found, at least 0.9 of the others, and nothing that is not alike."""
    rows = passage_corpus(seed)
    found = {}
    got = passages.repeated_passages(docs(spark, rows)).collect()
    for x in got:
        found.setdefault(x["doc_id"], []).append(x)
    table = shingle_table(rows)
    exact, near, hit = 0, 0, 0
    for j, x in table.items():
        alike, same = np.zeros(max(0, len(x) - 45), bool), np.zeros(max(0, len(x) - 45), bool)
        for i, y in table.items():
            if i < j:
                a, b = alike_windows(x, y)
                alike, same = alike | a, same | b
        spans = [(p["start"], p["end"]) for p in found.get(j, [])]
        for k in np.flatnonzero(same):
            exact += 1
            assert any(a <= k and k + 50 <= b for a, b in spans), (j, k)
        # a near copy is found if a returned passage holds most of a stretch that is alike
        parts = np.split(np.flatnonzero(alike & ~same), np.flatnonzero(np.diff(np.flatnonzero(alike & ~same)) > 1) + 1)
        for part in parts:
            if len(part):
                near += 1
                hit += any(min(b, part[-1] + 50) - max(a, part[0]) >= 40 for a, b in spans)
    words = {i: t.lower().split() for i, t in rows}
    for p in got:
        one, two = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words[p["doc_id"]][p["start"] : p["end"]], words[p["source_doc_id"]][p["source_start"] : p["source_end"]]))
        assert min(p["end"] - p["start"], p["source_end"] - p["source_start"]) >= 50 and len(one & two) >= 0.8 * len(one | two) - 1e-9
    print(f"exact {exact}, near {hit} of {near}")
    assert exact > 100 and near > 30 and hit >= 0.9 * near


def test_passages_whose_halves_earlier_documents_hold(spark):
    rows, want = [], set()
    for g in range(40):
        passage = prose(f"planted {g}", 60, 10**6).split()
        for k in range(6):
            half = passage[:30] if k % 2 else passage[30:]
            rows.append((10 * g + k, prose(f"{g} {k} a", 40, 10**6) + " " + " ".join(half) + " " + prose(f"{g} {k} b", 40, 10**6)))
        for k in (7, 8):
            rows.append((10 * g + k, prose(f"{g} {k} a", 30, 10**6) + " " + " ".join(passage) + " " + prose(f"{g} {k} b", 30, 10**6)))
        want.add((10 * g + 8, 10 * g + 7, 30, 90))
    got = {(x["doc_id"], x["source_doc_id"], x["start"], x["end"]) for x in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == want


def least_values(words):
    """By function: the least value over a text's shingles, and where it is."""
    value = passages.tokens(*textkernels.buffers(pa.array([" ".join(words)])), 5)[0]
    made = [textkernels.mix(value ^ np.uint64(0x100000001B3 * (f + 1))) for f in range(passages.HASHES)]
    return [(int(m.min()), int(m.argmin())) for m in made]


def test_passages_whose_keys_many_unlike_documents_hold(spark):
    """20 earlier documents hold the least shingle of every function of a passage, and nothing else of it; its changed copy is found."""
    r = random.Random(3)
    fresh = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(50)
    while len({at // 5 for _, at in least_values(passage)}) < 5 or sum(m for m, _ in least_values(passage)) > 0.05 * 2**64:
        passage = fresh(50)
    least = least_values(passage)
    fixed = {at + k for _, at in least for k in range(5)}

    def same_least(change):
        """A text in which words outside these shingles are others, and none of its own shingles has a lesser value."""
        while True:
            made = passage[:]
            for at in change:
                made[at] = fresh(1)[0]
            if least_values(made) == least:
                return made

    free = [k for k in range(50) if k not in fixed]
    rows = [(i, " ".join(same_least(free))) for i in range(20)]
    changed = same_least([next(k for k in free if 4 < k < 45)])
    rows += [(100, " ".join(passage)), (200, " ".join(changed))]
    got = passages.repeated_passages(docs(spark, rows), sources_per_key=1).collect()  # two further rounds
    assert [(x["doc_id"], x["source_doc_id"], x["start"], x["end"], x["source_start"], x["source_end"]) for x in got] == [(200, 100, 0, 50, 0, 50)]


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return {i: find(i) for i in ids}


def covered_places(groups):
    """Per group 24 documents with a passage changed early, one with it changed late, which no other leads to, and the passage itself."""
    rows = []
    for g in range(groups):
        passage = prose(f"p{g}", 60, 10**6).split()
        held = [[*passage[:k], f"c{k}", *passage[k + 1 :]] for k in [*range(14, 26)] * 2 + [40]] + [passage]
        rows += [(100 * g + k, " ".join([prose(f"a{g} {k}", 40, 10**6), *w, prose(f"z{g} {k}", 40, 10**6)])) for k, w in enumerate(held)]
    return rows


def test_passage_classes_of_covered_places(spark):
    """Earlier documents cover the place that alone leads to a further one."""
    rows, groups = covered_places(8), 8
    rows += [*((i + 5000, t) for i, t in ODD), (None, prose("x", 80)), (90, rows[-1][1].upper() + "\n"), (91, rows[-1][1])]
    got = {r["doc_id"]: r["component_id"] for r in passages.passage_classes(docs(spark, rows)).collect()}
    assert got.keys() == {i for i, _ in rows if i is not None}
    assert all(got[i + 5000] == i + 5000 for i, _ in ODD)
    first = [100 * g for g in range(groups - 1)] + [90]
    for g, least in enumerate(first):
        assert got[100 * g + 25] == least and {got[100 * g + k] for k in range(26)} <= {least, *range(100 * g, 100 * g + 26)}
    assert got[91] == 90
    # a changed version is found with a probability
    assert sum(got[100 * g + 24] == least for g, least in enumerate(first)) >= 5
    assert passages.passage_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_passage_classes_against_all_pairs(spark, seed):
    """No exact repeat parts classes, few others do, and classes join nothing that is not alike."""
    rows = passage_corpus(seed)
    rows += [(1000 + i, t) for i, t in rows[::9]]
    got = {r["doc_id"]: r["component_id"] for r in passages.passage_classes(docs(spark, rows)).collect()}
    table, links, exact = shingle_table(rows), [], []
    for (i, x), (j, y) in itertools.combinations(table.items(), 2):
        near, same = alike_windows(x, y)
        if near.any() or same.any():
            links.append((i, j))
        if same.any():
            exact.append((i, j))
    assert exact and all(got[i] == got[j] for i, j in exact)
    assert sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)
    words = {i: t.split() for i, t in rows}
    assert set(got) == set(words)
    loose = closure(got, [(i, j) for (i, x), (j, y) in itertools.combinations(table.items(), 2) if len(np.intersect1d(x, y)) >= 37])
    assert all(loose[i] == loose[c] for i, c in got.items())


def test_passage_classes_make_no_finer_keys_of_one_class(spark, monkeypatch):
    """What the stars have joined leaves no rows for later rounds, however many documents hold a passage."""
    made, materialize = {}, passages.materialize

    def counted(df, name="step"):
        out = materialize(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    passage = prose("held by all", 60, 10**6)
    rows = [(i, " ".join([prose(f"before {i}", 40, 10**6), passage, prose(f"after {i}", 40, 10**6)])) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in passages.passage_classes(docs(spark, rows)).collect()}
    assert got == dict.fromkeys(range(60), 0)
    assert sum(made["windows"]) >= 60 and made["finer"] == [0]


def test_passages_with_moved_halves_and_wide_gaps(spark):
    one, two = prose("moved", 60, 10**6).split(), prose("gap", 96, 10**6).split()
    rows = [
        (1, prose(1, 60, 10**6) + " " + " ".join(one) + " " + prose(2, 60, 10**6)),
        (2, prose(3, 50, 10**6) + " " + " ".join(one[30:] + one[:30]) + " " + prose(4, 60, 10**6)),
        (3, prose(5, 50, 10**6) + " " + " ".join(two) + " " + prose(6, 60, 10**6)),
        (4, prose(7, 50, 10**6) + " " + " ".join(two[:48]) + " " + prose(8, 13, 10**6) + " " + " ".join(two[48:]) + " " + prose(9, 60, 10**6)),
    ]
    got = {(x["doc_id"], x["source_doc_id"], x["start"], x["end"]): x["similarity"] for x in passages.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(2, 1, 50, 110): pytest.approx(52 / 60), (4, 3, 50, 159): pytest.approx(88 / 109)}


def test_pii_of_a_very_long_text_takes_linear_time(spark):
    import time

    def seconds(n):
        text = ",".join(["12"] * n) + "; card 4111.1111.1111.1111; " + ",".join(["4111 1111 1111 1111"] * (n // 20))
        began = time.perf_counter()
        (row,) = pii.find(docs(spark, [(1, text)])).collect()
        assert len(row["base"]) == n // 20 and len(row["added"]) <= 1
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 60


def test_pii_overlaps_follow_the_base(spark):
    """Added spans against a plain sweep: none meets a base span, and of those that meet each other the first stays."""
    r = random.Random(12)
    bits = ["call phone 200 555 0100", "+1 (200) 555-0100", "4111 1111 1111 1111", "4111.1111.1111.1111", "10.0.0.1", "10[.]0[.]0[.]1", "a (at) b (dot) com", "x@y.com", " ", "-", "mail "]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 40)))) for i in range(120)] + [(1000 + i, " phone 200 555 01" + f"{i:02}" + " now") for i in range(60)]
    texts = docs(spark, rows)
    made = pii.candidates(texts)
    patterns = [(x["k"], tuple(x["votes"]), x["shape"]) for row in made.collect() for x in row["found"]]
    weights = pii.fit(sorted((*p, n) for p, n in Counter(patterns).items()))
    want = {}
    for row in made.collect():
        base = [(x["start"], x["end"]) for x in row["found"] if x["ok"]]
        out = []
        for x in sorted((x for x in row["found"] if x["loose"]), key=lambda x: (x["start"], x["k"], x["end"])):
            score = sum(weights.get(f, 0.0) for f in pii.features(x["k"], tuple(x["votes"]), x["shape"]))
            if score >= 0 and not any(a < x["end"] and x["start"] < b for a, b in base) and (not out or out[-1][2] <= x["start"]):
                out.append((x["start"], x["k"], x["end"]))
        want[row["doc_id"]] = out
    got = {x["doc_id"]: [tuple(s) for s in x["added"]] for x in pii.find(texts).collect()}
    assert got == want and sum(map(len, want.values())) > 60


def test_added_spans_are_right(spark):
    """Spans of looser forms, labelled by the words before them: what is added, and what is left."""
    r = random.Random(21)
    good, bad = ["call me at phone", "our fax is", "mobile", "whatsapp"], ["order", "invoice number", "serial", "score"]
    rows, real = [], set()
    for i in range(400):
        yes = r.random() < 0.6
        said = r.choice(good if yes else bad)
        number = f"{r.randrange(200, 999)} {r.randrange(200, 999)} {r.randrange(1000, 9999)}"
        if not yes:
            number = f"1{number[1:]}"
        rows.append((i, f"{prose(i, 12)} {said} {number} {prose(i + 5000, 8)}"))
        if yes:
            real.add(i)
    rows += [(1000 + i, f"phone +1 (200) 555-0{100 + i} and order 12345{i:02}") for i in range(80)]
    found = {x["doc_id"] for x in pii.find(docs(spark, rows)).collect() if x["added"]}
    assert len(found & real) >= 0.95 * len(real) and len(found - real) <= 0.05 * len(rows)
