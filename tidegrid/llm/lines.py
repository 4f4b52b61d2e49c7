r"""Line dedup: a deletion-neighbourhood join that keeps the earliest line.

A document's lines are the pieces of its text between ``\n``. Lines of at
least ``min_chars`` code points take part; shorter ones stay as they are. A
line is dropped when an earlier one, by (doc_id, line number), is equal to it
or at most ``max_edits`` (0 or 1) code points away: inserted, deleted or
replaced. That earlier line is its keeper, the earliest one if there are more.

Equal lines are found by one aggregation over 128-bit hashes. The distinct
lines emit hashed variants:

* one per position, keyed by (rest, position): lines with an equal key differ
  in that code point alone, so the earliest of a key keeps the others;
* one per deletion, keyed by the rest, and the whole line keyed by itself: an
  equal key links a line to those that have one code point more.

So no pairs within a key are ever listed. Only lines that can have a partner
emit variants: one edit leaves the first or the second half of a line as it
was, so a line whose halves nobody shares at a fitting length has none. This
filter loses nothing. Every pair is verified by its edit distance.

Null texts and texts without long lines drop nothing. Rows of a null doc_id
take no part. Rows with an equal doc_id count as one document: the same line
at the same number is one line; another line at that number is one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, let, materialize, maybe_broadcast, table, tidy
from .textkernels import mix, powers

MIN_CHARS = 20


def long_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no (from 0), line, length of every line that takes part."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("length", F.char_length("line")).where(F.col("length") >= min_chars)


def _half_keys() -> list:
    """The halves' hashes of a line as the shorter of a pair (or of equal length), and as the longer."""
    keys = []
    for role, c in ((0, F.col("length")), (1, F.col("length") - 1)):
        half = F.floor(c / 2).cast("int")
        keys += [
            F.struct(F.xxhash64(c, F.lit(0), F.left("line", half)).alias("key"), F.lit(role).alias("role")),
            F.struct(F.xxhash64(c, F.lit(1), F.right("line", c - half)).alias("key"), F.lit(role).alias("role")),
        ]
    return keys


def variants(lines: DataFrame) -> DataFrame:
    """key, mark of lines(ref, line, sub, whole, del): mark is 2 * ref, plus 1 for a deletion from a longer line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, marks, held = [], [], 0
            for ref, line, sub, whole, dele in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                n = len(c)
                up, down = powers(n + 1)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(c * up[:n], out=total[1:])
                rest = total[:-1] + (total[n] - total[1:]) * down[1]
                made = []
                if sub:
                    made.append((mix(mix(rest + np.uint64(n)) + np.arange(1, n + 1, dtype=np.uint64)), 2 * ref))
                if dele:
                    made.append((mix(np.unique(rest) + np.uint64(n - 1)) ^ np.uint64(0x5BD1E995), 2 * ref + 1))
                if whole:
                    made.append((mix(total[n:] + np.uint64(n)) ^ np.uint64(0x5BD1E995), 2 * ref))
                for k, m in made:
                    keys.append(k)
                    marks.append(np.full(len(k), m, np.int64))
                    held += len(k)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(marks))], ["key", "mark"])
                    keys, marks, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(marks))], ["key", "mark"])

    return lines.select("ref", "line", "sub", "whole", "del").mapInArrow(tidy(work), "key long, mark long")


def duplicate_lines(documents: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, line_hash: bool = False) -> DataFrame:
    """doc_id, line_no, keeper_doc_id, keeper_line_no, distance of every line to drop; with ``line_hash`` its hash, too."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    bounded_batches(documents.sparkSession)
    found = long_lines(documents, min_chars)
    h = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line", "length").alias("h2")]
    occurrences = materialize(found.select("doc_id", "line_no", *h, F.array(*_half_keys()).alias("halves")), "lines")
    first = F.min(F.struct("doc_id", "line_no")).alias("at")
    distinct = materialize(occurrences.groupBy("h1", "h2").agg(first, F.first("halves").alias("halves"), F.count("*").alias("n")), "distinct")

    keepers = distinct.where("n > 1").select("h1", "h2", F.col("at.doc_id").alias("keeper_doc_id"), F.col("at.line_no").alias("keeper_line_no"))
    copies = occurrences.select("doc_id", "line_no", "h1", "h2").join(keepers, ["h1", "h2"])
    copies = copies.where("doc_id <> keeper_doc_id or line_no <> keeper_line_no")
    copies = copies.select("doc_id", "line_no", "keeper_doc_id", "keeper_line_no", F.lit(0).alias("distance"), F.col("h1").alias("line_hash")).distinct()
    if max_edits == 0:
        return copies if line_hash else copies.drop("line_hash")

    # which distinct lines share a half with another at a fitting length, and how the two may differ
    halves = distinct.select("at.*", F.col("h1").alias("check"), F.inline("halves"))
    shared = halves.groupBy("key").agg(F.count_if(F.expr("role = 0")).alias("n0"), F.count_if(F.expr("role = 1")).alias("n1")).where("n0 > 1 or (n0 > 0 and n1 > 0)")
    shared = maybe_broadcast(materialize(shared, "halves"), 40)  # counted by parts before the exchange: a frequent half is one row
    open_lines = (
        halves.join(shared, "key")
        .groupBy("doc_id", "line_no", "check")
        .agg(F.bool_or(F.expr("role = 0 and n0 > 1")).alias("sub"), F.bool_or(F.expr("role = 0 and n1 > 0")).alias("whole"), F.bool_or(F.expr("role = 1 and n0 > 0")).alias("del"))
        .where("sub or whole or del")
    )
    open_lines = materialize(open_lines, "open")
    wanted = open_lines.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "check", "sub", "whole", "del")).alias("wanted"))
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n").alias("lines")).join(wanted, "doc_id")
    texts = texts.select("doc_id", "lines", F.inline("wanted")).where("line_no < size(lines)").withColumn("line", F.get("lines", "line_no")).drop("lines")
    texts = texts.where("xxhash64(line) = check").dropDuplicates(["doc_id", "line_no", "check"])
    texts = texts.repartitionByRange("doc_id", "line_no", "check").sortWithinPartitions("doc_id", "line_no", "check")
    texts = materialize(texts.withColumn("ref", F.monotonically_increasing_id()), "texts")  # refs ascend with (doc_id, line_no)

    rows = variants(texts).repartition("key")  # lines of one key differ in one code point, so no key has a share of the rows
    ref, longer = F.shiftright("mark", 1), F.col("mark").bitwiseAND(1) == 1
    least = rows.groupBy("key").agg(F.min(F.when(~longer, ref)).alias("plain"), F.min(F.when(longer, ref)).alias("shortened"), F.count("*").alias("n"))
    # for a shortened line the whole one of its key; for a whole one the shortened; for a replaced code point the earliest
    other = F.when(longer, F.col("plain")).otherwise(F.least("shortened", "plain"))
    pairs = rows.join(least.where("n > 1"), "key").select(ref.alias("ref"), other.alias("keeper")).where("keeper < ref").distinct()
    a, b = texts.select("ref", "doc_id", "line_no", "line", "check"), texts.select("ref", "doc_id", "line_no", "line").toDF("keeper", "keeper_doc_id", "keeper_line_no", "kept")
    near = pairs.join(a, "ref").join(b, "keeper").withColumn("distance", F.levenshtein("line", "kept", 1)).where("distance between 1 and 1")
    near = near.groupBy("doc_id", "line_no", "check").agg(F.min(F.struct("keeper_doc_id", "keeper_line_no", "distance")).alias("k"))
    found = copies.union(near.select("doc_id", "line_no", "k.*", F.col("check").alias("line_hash")))
    return found if line_hash else found.drop("line_hash")


def drop_lines(documents: DataFrame, drops: DataFrame) -> DataFrame:
    """The documents without the dropped lines; n_chars follows.

    A document with nothing but white space left goes if a line was dropped
    from it; all others stay, null and empty texts included. Extra columns
    pass through, whatever their names. Rows that repeat a doc_id lose the
    lines of those numbers each, or, if drops has the column ``line_hash``
    (as of ``duplicate_lines``), only the lines that it was made of.
    """
    named = "line_hash" in drops.columns
    places = F.shiftleft(F.col("line_no").cast("long"), 32)
    hashes = lambda h: h.bitwiseAND(0xFFFFFFFF) if named else F.lit(0).cast("long")
    id_, gone, row = (free_name(documents, n) for n in ("id", "gone", "row"))
    lost = drops.groupBy(F.col("doc_id").cast("long").alias(id_)).agg(F.collect_set(places.bitwiseOR(hashes(F.col("line_hash") if named else None))).alias(gone))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(row))
    both = whole.join(lost, F.col(f"{row}.doc_id") == F.col(id_), "left")

    def kept(lines: Column) -> Column:
        marks = F.transform(lines, lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(hashes(F.xxhash64(x))))
        return F.array_join(F.transform(F.array_except(marks, F.col(gone)), lambda m: F.get(lines, F.shiftright(m, 32).cast("int"))), "\n")

    changed = F.col(gone).isNotNull() & F.col(f"{row}.text").isNotNull()
    text = F.when(changed, let(F.split(F.col(f"{row}.text"), "\n"), kept)).otherwise(F.col(f"{row}.text"))
    left = free_name(documents, "left")
    both = both.withColumn(left, text)
    text, out = F.col(left), []
    for c in documents.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.when(changed, F.char_length(text).cast(documents.schema[c].dataType)).otherwise(F.col(f"{row}.n_chars")).alias(c))
        else:
            out.append(F.col(f"{row}.`{c}`").alias(c))
    return both.where(~changed | (F.trim(text, F.lit(" \t\r\n")) != "")).select(*out)


def query(spark, sf_dir):
    return duplicate_lines(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM t),
o AS (SELECT * FROM l WHERE length(line) >= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k,
        first_value(doc_id) OVER (PARTITION BY line ORDER BY doc_id, line_no) AS kd,
        first_value(line_no) OVER (PARTITION BY line ORDER BY doc_id, line_no) AS kl FROM o),
d AS (SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) AS ref FROM f WHERE k = 1),
v AS (SELECT ref, i, md5(line[1:i - 1] || line[i + 1:]) AS rest FROM (SELECT ref, line, unnest(range(1, length(line) + 1)) AS i FROM d)),
w AS (SELECT ref, md5(line) AS whole FROM d),
p AS (SELECT x.ref, min(y.ref) AS keeper FROM v x JOIN v y ON x.rest = y.rest AND x.i = y.i AND y.ref < x.ref GROUP BY 1
      UNION ALL SELECT v.ref, w.ref FROM v JOIN w ON v.rest = w.whole WHERE w.ref < v.ref
      UNION ALL SELECT w.ref, v.ref FROM v JOIN w ON v.rest = w.whole WHERE v.ref < w.ref),
m AS (SELECT ref, min(keeper) AS keeper FROM p GROUP BY 1)
SELECT doc_id, line_no, kd AS keeper_doc_id, kl AS keeper_line_no, 0 AS distance FROM f WHERE k > 1
UNION ALL
SELECT a.doc_id, a.line_no, b.doc_id, b.line_no, 1 FROM m JOIN d a ON a.ref = m.ref JOIN d b ON b.ref = m.keeper
"""
