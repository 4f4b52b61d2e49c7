r"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

Texts are lower-cased and cut into words at anything but letters and digits.
A seed is a fixed mask over neighbouring words that looks at some positions
and ignores the others; the hashes of the words it looks at are joined between
documents and benchmark items. A hit fixes an alignment (document position
less item position), and along it every word of the overlap is compared:
+1 for an equal word, -1 for a substituted one. The best stretch of an
alignment is an overlap if it scores ``min_score`` at least: as many words in
a row, or more with substitutions between them.

Most positions of a text can match no seed, as their neighbouring words stand
in no item: a bit array of fixed size over the items' neighbouring words tells
so before any seed is made. Its false hits cost time only.

The hashed seeds of the benchmark are broadcast only if their counted size is
under 64 MB; beyond it the same join goes by a shuffle.

Null or empty texts have no words and no overlaps. Items with fewer words than
``min_score`` cannot score enough. Rows with a null id take part in nothing.
Rows that repeat an id count as one text each; the best overlap of the id is
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table

#: Fixed masks: 1 looks at a word, 0 ignores it.
MASKS = ("11011001", "1010111", "110010011")
MIN_SCORE = 8
CELLS = 1 << 14


def hashed_words(text: Column | str) -> Column:
    """Hashes of the words of a text; null: none."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seeds(words: str, masks: tuple[str, ...], starts: list[Column] | None = None) -> Column:
    """(mask, at, seed) of the masks laid at all positions of the words, or at those of ``starts``, mask by mask."""

    def hashes(m: int, mask: str) -> Column:
        looked = [k for k, c in enumerate(mask) if c == "1"]
        last = F.size(words) - F.lit(len(mask))
        none = F.array().cast("array<int>")
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none) if starts is None else F.filter(starts[m], lambda i: (i >= 0) & (i <= last))
        return F.transform(at, lambda i: F.struct(F.lit(m).alias("mask"), i.alias("at"), F.xxhash64(F.lit(m), *[F.get(F.col(words), i + k) for k in looked]).alias("seed")))

    return F.flatten(F.array(*[hashes(m, mask) for m, mask in enumerate(masks)]))


def _mark(word: Column, after: Column) -> Column:
    """A number for two neighbouring words."""
    return word.bitwiseXOR(F.shiftleft(after, 1))


def pair_filter(items: DataFrame) -> Column:
    """A bit array, as a constant, of the neighbouring words of all items: ``CELLS`` numbers of 64 bits, whatever their number."""
    pairs = items.select(F.inline(F.arrays_zip(F.col("iw").alias("w"), F.slice("iw", 2, F.greatest(F.size("iw"), F.lit(1))).alias("v")))).where("v is not null")
    mark = _mark(F.col("w"), F.col("v"))
    cell, bit = mark.bitwiseAND(CELLS - 1), F.shiftrightunsigned(mark, 58)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
    rows = pairs.select(cell.alias("cell"), bit.alias("bit")).distinct().groupBy("cell").agg(F.bit_or(one).alias("bits"))
    cells = [0] * CELLS
    for r in rows.collect():  # at most CELLS rows
        cells[r["cell"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")


def possible_starts(words: str, masks: tuple[str, ...], cells: Column) -> list[Column]:
    """Per mask the positions where its first and last neighbouring looked-at words stand in some item; all of those where a seed can match."""

    def known(w: Column, i: Column) -> Column:
        mark = _mark(w, F.get(F.col(words), i + 1))
        return F.when(F.getbit(F.get(cells, mark.bitwiseAND(CELLS - 1).cast("int")), F.shiftrightunsigned(mark, 58)) == 1, i)

    def back(k: int) -> Column:
        return F.transform("hits", lambda p: p - k)

    hits = F.array_compact(F.transform(words, known))
    out = []
    for mask in masks:
        near = [k for k in range(len(mask) - 1) if mask[k : k + 2] == "11"]
        out.append(F.array_intersect(back(near[0]), back(near[-1])))
    return [hits, *out]


def overlaps(documents: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, length, matches, score of the best overlap of each pair that has one."""
    if not all("11" in mask for mask in masks):
        raise ValueError("a mask needs two looked-at words side by side")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), hashed_words("text").alias("iw"))
    items = materialize(items.where(F.size("iw") > 0), "items")
    probes = items.select("item_id", F.inline(seeds("iw", masks))).select("item_id", "mask", "seed", F.col("at").alias("item_at"))
    probes = maybe_broadcast(materialize(probes, "probes"), 64)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits, *starts = possible_starts("dw", masks, pair_filter(items))
    found = texts.select("doc_id", hashed_words("text").alias("dw")).select("doc_id", "dw", hits.alias("hits"))
    found = found.select("doc_id", F.inline(seeds("dw", masks, starts)))
    hits = found.join(probes, ["seed", "mask"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialize(hits, "hits")

    wanted = hits.groupBy("doc_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    wanted = materialize(wanted, "wanted")
    both = texts.join(maybe_broadcast(wanted, 128), "doc_id").select("doc_id", "item_id", "shifts", hashed_words("text").alias("dw"))
    both = both.join(maybe_broadcast(items, 4096), "item_id")
    best = both.select("doc_id", "item_id", F.inline(F.transform("shifts", lambda s: _stretch(F.col("dw"), F.col("iw"), s))))
    kept = best.where(F.col("score") >= min_score)
    order = F.struct("score", "length", F.negative("doc_start").alias("x"), F.negative("item_start").alias("y"), "matches")
    kept = kept.groupBy("doc_id", "item_id").agg(F.max(order).alias("k"))
    return kept.select(
        "doc_id", "item_id", F.negative("k.x").alias("doc_start"), F.negative("k.y").alias("item_start"), "k.length", "k.matches", "k.score"
    )


def _stretch(dw: Column, iw: Column, shift: Column) -> Column:
    """The best-scoring stretch of an alignment: the first of the highest score, the longest of these."""
    lo = F.greatest(F.lit(0), -shift)
    hi = F.least(F.size(iw), F.size(dw) - shift) - 1
    zero = F.lit(0)
    none = F.struct(zero.alias("run"), lo.alias("since"), zero.alias("same"), zero.alias("score"), lo.alias("first"), (lo - 1).alias("last"), zero.alias("matches"))

    def step(acc: Column, j: Column) -> Column:
        equal = F.when(F.get(dw, j + shift) == F.get(iw, j), 1).otherwise(0)
        fresh = acc["run"] <= 0
        run = F.when(fresh, 0).otherwise(acc["run"]) + 2 * equal - 1
        since = F.when(fresh, j).otherwise(acc["since"])
        same = F.when(fresh, 0).otherwise(acc["same"]) + equal
        better = run > acc["score"]
        return F.struct(
            run.alias("run"),
            since.alias("since"),
            same.alias("same"),
            F.when(better, run).otherwise(acc["score"]).alias("score"),
            F.when(better, since).otherwise(acc["first"]).alias("first"),
            F.when(better, j).otherwise(acc["last"]).alias("last"),
            F.when(better, same).otherwise(acc["matches"]).alias("matches"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            acc["score"].alias("score"),
            (acc["last"] - acc["first"] + 1).alias("length"),
            (acc["first"] + shift).alias("doc_start"),
            acc["first"].alias("item_start"),
            acc["matches"].alias("matches"),
        )

    return F.aggregate(F.sequence(lo, F.greatest(lo, hi)), none, step, finish)


def query(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    looks = " UNION ALL ".join(
        f"SELECT {{id}}, unnest(range(0, len(ws) - {len(mask) - 1})) AS pos, {m} AS m FROM {{src}}" for m, mask in enumerate(MASKS)
    )
    key = "CASE m " + " ".join(
        f"WHEN {m} THEN concat_ws(' ', {', '.join(f'ws[pos + {k + 1}]' for k, c in enumerate(mask) if c == '1')})" for m, mask in enumerate(MASKS)
    ) + " END"
    cut = r"list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')".replace("{{", "{").replace("}}", "}")
    return f"""
WITH d AS (SELECT doc_id, {cut} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {cut} AS ws FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, m, pos, {key} AS s FROM ({looks.format(id='doc_id, ws', src='d')})),
bs AS (SELECT item_id, m, pos, {key} AS s FROM ({looks.format(id='item_id, ws', src='i')})),
h AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS shift FROM ds JOIN bs USING (m, s)),
a AS (SELECT doc_id, item_id, shift, d.ws AS dw, i.ws AS iw, greatest(0, -shift) AS lo, least(len(i.ws), len(d.ws) - shift) AS hi
      FROM h JOIN d USING (doc_id) JOIN i USING (item_id)),
p AS (SELECT doc_id, item_id, shift, j, CASE WHEN dw[j + shift + 1] = iw[j + 1] THEN 1 ELSE 0 END AS eq
      FROM (SELECT *, unnest(range(lo, hi)) AS j FROM a)),
c AS (SELECT *, sum(2 * eq - 1) OVER w AS s, sum(eq) OVER w AS e FROM p WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY j)),
m AS (SELECT x.doc_id, x.item_id, x.shift, y.j AS first, x.j AS last, x.s - y.s + 2 * y.eq - 1 AS score, x.e - y.e + y.eq AS matches
      FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.shift = y.shift AND y.j <= x.j),
r AS (SELECT *, last - first + 1 AS length, row_number() OVER (PARTITION BY doc_id, item_id
        ORDER BY score DESC, last, first DESC) AS k0 FROM m WHERE score >= {MIN_SCORE}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY score DESC, last, first) AS k1 FROM r) WHERE k1 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, length DESC, first + shift, first) AS k2 FROM b)
SELECT doc_id, item_id, CAST(first + shift AS INTEGER) AS doc_start, CAST(first AS INTEGER) AS item_start, CAST(length AS INTEGER) AS length,
  CAST(matches AS INTEGER) AS matches, CAST(score AS INTEGER) AS score FROM f WHERE k2 = 1
"""


SQL = _sql()
