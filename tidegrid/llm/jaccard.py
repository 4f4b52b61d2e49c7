r"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set holds the hashes of its distinct word shingles. Documents of
equal sets form a class; the least doc_id stands for it, so copies cost one
aggregation. Two sets link when ``100 * |x & y| >= percent * |x | y|``, which
bounds their sizes' ratio and their symmetric difference by
``(|x| + |y|) * (100 - percent) / (100 + percent)``.

Sizes are cut into bands. In the tiles of a band every set is dealt by hash
into more parts than the largest possible difference of its pairs, so two
linked sets agree in some parts: a tile is the classes that share the hash of
such a part. There are some parts to spare, so that a set with no more empty
parts than these agrees in one that is not empty; others emit their empty
parts, too. This loses no link, and a common line or passage makes no tile,
as the other shingles of the part differ.

Inside a tile the parity bitmaps of two sets bound their overlap from above:
each differing bit is a shingle that only one of them has. A bitmap has two
bits and more per shingle; a longer one is folded to the length of the other.
Pairs that pass are decided by the intersection of their sorted shingle
arrays.

Not all pairs of a tile need a decision to find the components. First every
class is compared with the least one of its tiles. Only tiles that then still
hold several components are cut into blocks of bounded size, and pairs of
different components compared block by block: still every link between
different components is found.

Null and empty texts have an empty set and link with nothing. Rows without a
doc_id are returned with no component. Rows that repeat a doc_id are copies if
their texts agree; if not, they count as one document with several texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, materialize, maybe_broadcast, table, tidy
from .textkernels import buffers, mix, shingles, span_hashes, words

LEAST_BITS, MOST_BITS = 512, 1 << 17
GROWTH = 1.35
BLOCK = 512


def sets(column: pa.Array, size: int, pieces: int = 1 << 19) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, working on about ``pieces`` bytes at a time."""
    data, offsets = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + pieces, "right")) - 1)
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = words(part, offsets[a : b + 1] - offsets[a])
        value, begin = shingles(span_hashes(part, starts, ends), first, size)
        for k in range(b - a):
            yield np.unique(value[begin[k] : begin[k + 1]])
        a = b


def band_start(band: int) -> int:
    """The least size of a band: each starts GROWTH times as high as the one before."""
    at = 1
    for _ in range(band):
        at = max(at + 1, int(at * GROWTH))
    return at


_starts = [band_start(k) for k in range(70)]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The tile keys of a set: one per part, in its own band and in those above that it can link into."""
    n, found = len(s), []
    band = int(np.searchsorted(_starts, n, "right")) - 1
    while band == 0 or 100 * n >= percent * _starts[band]:
        top = _starts[band + 1] - 1
        differ = 2 * top * (100 - percent) // (100 + percent)
        spare = 2 + differ // 8 if differ else 0
        parts = differ + 1 + spare
        value = mix(s ^ np.uint64(0x51ED270B + band))
        part = (value % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part, mix(value + np.uint64(0x2545F491)))
        key = mix(total + mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)))
        held = np.bincount(part, minlength=parts) > 0
        found.append(key[held] if parts - held.sum() <= spare else key)
        band += 1
        if band >= len(_starts) - 1:
            break
    return np.concatenate(found).view(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Which bits an odd number of the set's hashes falls on."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(s)).bit_length()))
    odd = np.bincount((mix(s + np.uint64(0x1B873593)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: bytes, to: int) -> bytes:
    """A bitmap as if it had been made with ``to`` bytes."""
    if len(bits) == to:
        return bits
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, to // 8), axis=0).tobytes()


def sketch(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2 (a hash of the whole set), bitmap, sigs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "h1", "h2", "bitmap", "sigs"]
        for b in batches:
            rows, sigs, lengths = [], [], [0]
            for s in sets(b.column(1), size):
                one, two = int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x9E3779B1)).sum(dtype=np.uint64))
                rows.append((len(s), one - (1 << 63), two - (1 << 63), bitmap(s) if len(s) else None))
                if len(s):
                    sigs.append(signatures(s, percent))
                lengths.append(lengths[-1] + (len(sigs[-1]) if len(s) else 0))
            n, h1, h2, bits = zip(*rows, strict=True) if rows else ([], [], [], [])
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sigs) if sigs else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bits, pa.binary()), lists], names
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(work), "doc_id long, n long, h1 long, h2 long, bitmap binary, sigs array<long>")


def _possible(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the sizes and the bitmaps leave open."""
    wide = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    differ = np.zeros(len(a), np.int64)
    for to in np.unique(wide).tolist():
        at = np.flatnonzero(wide == to)
        x, y = (np.frombuffer(b"".join(fold(v[k], to) for k in at), np.uint64).reshape(len(at), -1) for v in (a, b))
        differ[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (differ * (100 + percent) <= (na + nb) * (100 - percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def links(pairs: DataFrame, reps: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the distinct pairs(a, b) that link: bitmaps first, then the arrays."""
    info = reps.select("rep", "n", "bitmap")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            c = {k: r.column(k) for k in ("a", "b", "na", "nb", "ma", "mb")}
            keep = _possible(c["ma"].to_pylist(), c["mb"].to_pylist(), c["na"].to_numpy(), c["nb"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(keep)), c["b"].filter(pa.array(keep))], ["a", "b"])

    both = pairs.join(info.toDF("a", "na", "ma"), "a").join(info.toDF("b", "nb", "mb"), "b")
    left = materialize(both.mapInArrow(tidy(bound), "a long, b long"), "possible")
    ids = materialize(left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct(), "ids")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([s.tobytes() for s in sets(r.column(1), size)], pa.binary())], ["id", "s"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(ids, 16), "doc_id", "left_semi")
    held = materialize(texts.mapInArrow(tidy(arrays), "id long, s binary"), "arrays")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = []
            for x, y in zip(r.column("sa"), r.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column("a").filter(mask), r.column("b").filter(mask)], ["a", "b"])

    full = left.join(held.toDF("b", "sb"), "b").join(held.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")
    return full.mapInArrow(tidy(exact), "a long, b long")


def tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Possible pairs(a, b), a < b, of different components from members(sig, rep, comp, leader, c, n, bitmap).

    A tile of more than BLOCK members is cut into blocks, and each pair of
    blocks is a tile of its own. The rows come sorted by tile, as a stream.
    """
    blocks = F.ceil(F.col("c") / BLOCK)
    cut = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.withColumn("tile", F.struct("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    cut = cut.select(F.xxhash64("tile").alias("t"), "sig", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "own", "rep", "comp", "leader", "n", "bitmap")
    cut = cut.repartition("t").sortWithinPartitions("t", "sig", "i", "j")

    def pairs_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        own, rep, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2, 4))
        leader = rows[0][3]
        least = min(len(r[5]) for r in rows)
        bits = np.frombuffer(b"".join(fold(r[5], least) for r in rows), np.uint64).reshape(len(rows), -1)
        i, j = rows[0][6], rows[0][7]
        found = [], []
        for k in range(len(rows)):
            # within one block each pair once; across two blocks from the first to the second
            there = np.arange(k + 1, len(rows)) if i == j else (np.flatnonzero(own == j) if own[k] == i else [])
            if not len(there) or rep[k] == leader:
                continue
            there = there[(comp[there] != comp[k]) & (rep[there] != leader)]
            small, large = np.minimum(n[there], n[k]), np.maximum(n[there], n[k])
            there = there[100 * small >= percent * large]
            if len(there):
                differ = np.bitwise_count(bits[there] ^ bits[k]).sum(axis=1, dtype=np.int64)
                there = there[differ * (100 + percent) <= (n[there] + n[k]) * (100 - percent)]
                found[0].append(np.minimum(rep[k], rep[there]))
                found[1].append(np.maximum(rep[k], rep[there]))
        return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()

        def out() -> pa.RecordBatch:
            a, b = pairs_of(rows)
            new = [p for p in dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)) if p not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], ["a", "b"])

        names = ("sig", "i", "j", "own", "rep", "comp", "leader", "n", "bitmap")
        for r in batches:
            for sig, i, j, own, rep, comp, leader, n, bits in zip(*(r.column(k).to_pylist() for k in names), strict=True):
                if (sig, i, j) != key:
                    if len(rows) > 1:
                        yield out()
                    key, rows = (sig, i, j), []
                rows.append((own, rep, comp, leader, n, bits, i, j))
        if len(rows) > 1:
            yield out()

    return cut.mapInArrow(tidy(work), "a long, b long").distinct()


def components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents(doc_id, text)."""
    bounded_batches(documents.sparkSession)
    sketches = materialize(sketch(documents, size, percent), "sketches")
    full = sketches.where("n > 0 and doc_id is not null")
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    reps = materialize(reps, "reps")
    chosen = maybe_broadcast(reps.select(F.col("rep").alias("doc_id"), "h1", "h2"), 48)
    dealt = full.join(chosen, ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("sigs").alias("sig"))
    # counted by parts before the exchange; the members of a tile then meet its one row, and need no exchange if there are few tiles
    tiles = dealt.groupBy("sig").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).where("c > 1")
    members = materialize(dealt.join(maybe_broadcast(materialize(tiles, "counted"), 32), "sig"), "tiles")
    pairs = materialize(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    edges = materialize(links(pairs, reps, documents, size, percent), "links")
    parts = materialize(connected_components(edges), "components")

    comp = F.coalesce("component", "rep").alias("comp")
    open_rows = members.where("c > 2").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "rep", "leader", "c", comp)
    several = open_rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    rest = open_rows.join(several, "sig", "left_semi").join(reps.select("rep", "n", "bitmap"), "rep")
    more = tile_pairs(rest, percent).join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "more")
    if not more.isEmpty():
        found = materialize(links(more, reps, documents, size, percent), "links")
        if not found.isEmpty():
            parts = materialize(connected_components(edges.union(found)), "components")

    owner = reps.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    owned = full.select("doc_id", "n", "h1", "h2").join(owner, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return owned.union(alone)


def query(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"), 3, 90)


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
f AS (SELECT doc_id, unnest(sh) AS g FROM s),
f2 AS (SELECT f.doc_id, hash(g) AS g, n FROM f JOIN n USING (doc_id)),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k FROM f2),
p AS (SELECT * FROM r WHERE k <= n - CAST(ceil(n * 0.9) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id
        AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      JOIN f2 x ON x.doc_id = a JOIN f2 y ON y.doc_id = b AND y.g = x.g
      GROUP BY a, b, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(n.doc_id, m.lo), n.doc_id) AS component_id
FROM n LEFT JOIN (
  WITH RECURSIVE reach AS (SELECT a AS x, b AS y FROM u UNION SELECT r.x, u.b FROM reach r JOIN u ON u.a = r.y)
  SELECT x, min(y) AS lo FROM reach GROUP BY x) m ON m.x = n.doc_id
"""
