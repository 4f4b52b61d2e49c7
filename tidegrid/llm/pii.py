r"""PII by weak supervision, in DataFrame operations alone.

Four kinds are looked for: email, ip, card, phone. Base patterns give base
spans, which always stay: leftmost non-overlapping matches per kind, of which
failing ones (an ip part above 255, a card without 12 to 19 digits or a wrong
check digit, a phone without 9 to 15 digits) are dropped without a retry.
Looser patterns add candidates: spelled-out addresses, numbers without a
country code, unusual separators; near misses of the base patterns are
candidates too.

Three kinds of labelers vote on every candidate (-1, 0, 1): the regular
expression's own check, a gazetteer (top-level domains, country codes, issuer
prefixes, reserved address blocks) and the context (words before the span;
the characters around it). Expectation-maximisation over the counts of the
vote patterns estimates how reliable each labeler is for each kind, and a
logistic span classifier over the votes and the span's shape (its length, what
stands between its parts and before it) is fitted to the
resulting probabilities. Looser candidates that it scores at 0.5 or more are
added unless they overlap a base span or an added one that starts before. Near
misses teach the labelers' reliability but are never added: a failed check
digit decides.

The driver sees counts per pattern of votes and shape only: at most 4 kinds of
81 votes and 64 shapes, whatever the corpus. Every text is read whole, once,
and the work is linear in its length: positions and contexts follow from the
pieces between the matches of a pattern, so the context of a span begins at
the match before it.

Null text is empty: a row without spans. Rows that repeat a doc_id are
returned one by one. The patterns are possessive and start only where a run
starts, so long runs of one character take linear time and no stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, table

KINDS = ("email", "ip", "card", "phone")

#: The base patterns; the same matches as the plain greedy forms, without backtracking.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser forms.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?:[./_]|[ -]{2,3})[0-9]{4}(?![0-9])",
    r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
)
#: A text without these cannot hold a match.
NEEDS = (("@",), (".",), (), ("+",))
LOOSE_NEEDS = (("at", "dot"), (), (), ())

PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co eu uk us ca au de fr es it nl be ch at se no dk fi pl pt ie ru jp cn in br mx ar example test"
COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[057-9][0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35"
RESERVED = "0*(?:0|127|2[3-5][0-9])[.\\[( ]"
#: Words before a span that speak for and against it.
CONTEXT = (
    ("mail|contact|write to|reach|courriel|correo|kontakt", "example of|regex|pattern"),
    (r"\bip\b|address|host|server|login|adresse|client", r"version|release|\bv\.?$|section|chapter|license"),
    ("card|visa|master|amex|credit|payment|carte|karte|tarjeta", "isbn|order|invoice|serial|tracking|doi"),
    ("phone|call|tel|fax|mobile|cell|whatsapp|anruf|appel|llama", "isbn|order|invoice|serial|score|version"),
)
REACH = 40


SCAN, WIDE = 512, 1 << 16


def _cut(items: Column, size: int) -> Column:
    """The items in blocks; they must be a column or a lambda's variable."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size)))


def _scan(items: Column, state: Column, none: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What step puts out along an array: (s: state, o: output so far) and the next item -> the same.

    Appending copies and so does cutting, so the output grows by blocks of
    blocks: the work is all but linear in the items.
    """

    def block(acc: Column, own: Column) -> Column:
        return F.aggregate(own, F.struct(acc["s"].alias("s"), none.alias("o")), step, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def run(all_: Column) -> Column:
        start = F.struct(state.alias("s"), F.slice(F.array(none), F.lit(1), F.lit(0)).alias("o"))
        blocks = F.flatten(F.transform(_cut(all_, WIDE), lambda wide: _cut(wide, SCAN)))
        return F.when(F.size(all_) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["o"]))).otherwise(none)

    return let(items, run)


FOUND = "struct<start:int,end:int,m:string,before:string,after:string>"


def _spans(pieces: Column, found: Column) -> Column:
    """The matches with their places, and up to REACH characters before and one after, from the pieces between them: no text is searched again."""
    return let(pieces, lambda p: _placed(p, found))


def _placed(pieces: Column, found: Column) -> Column:
    n = F.size(found)
    last = F.concat(F.array(F.lit("")), F.transform(found, lambda m: F.right(m, F.lit(1))))
    first = F.concat(F.slice(F.transform(found, lambda m: F.left(m, F.lit(1))), F.lit(2), F.greatest(n, F.lit(1))), F.array(F.lit("")))
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), n).alias("p"), found.alias("m"), F.slice(pieces, F.lit(2), n).alias("q"), F.slice(last, F.lit(1), n).alias("l"), F.slice(first, F.lit(1), n).alias("f"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["s"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        before = F.when(x["p"] == "", x["l"]).otherwise(F.right(x["p"], F.lit(REACH)))
        after = F.when(x["q"] == "", x["f"]).otherwise(F.left(x["q"], F.lit(1)))
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), before.alias("before"), after.alias("after")).cast(FOUND)
        return F.struct(end.alias("s"), F.concat(acc["o"], F.array(one)).alias("o"))

    return _scan(rows, F.lit(0), F.array().cast(f"array<{FOUND}>"), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _passes(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.rlike(m, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))
    n = F.char_length(_digits(m))
    if kind == 2:
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _near_miss(kind: int, m: Column) -> Column:
    n = F.char_length(_digits(m))
    return F.lit(True) if kind < 2 else n.between(12, 19) if kind == 2 else n.between(7, 20)


def _votes(kind: int, ok: Column, loose: bool, m: Column, before: Column, around: Column) -> list[Column]:
    def vote(plus: Column, minus: Column | None = None) -> Column:
        return F.when(plus, 1).when(~plus if minus is None else minus, -1).otherwise(0)

    digits = _digits(m)
    regex = vote(ok)
    if loose:  # the looser forms' own check, where there is one
        regex = vote(_luhn(digits)) if kind == 2 else vote(_passes(1, F.regexp_replace(m, "[^0-9]+", "."))) if kind == 1 else F.lit(0)
    if kind == 0:
        gazetteer = vote(F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS.split()))
    elif kind == 1:
        gazetteer = vote(~F.rlike(m, F.lit("^" + RESERVED)))
    elif kind == 2:
        gazetteer = vote(F.rlike(digits, F.lit(f"^(?:{ISSUERS})")))
    else:
        gazetteer = vote(F.rlike(digits, F.lit("^[2-9]" if loose else f"^(?:{COUNTRIES})")))
    plus, minus = (F.rlike(F.lower(before), F.lit(x)) for x in CONTEXT[kind])
    return [regex, gazetteer, vote(plus, minus), vote(~F.rlike(around, F.lit("[A-Za-z0-9]")))]


CANDIDATE = "struct<start:int,k:int,end:int,ok:boolean,loose:boolean,votes:array<int>,shape:int>"


#: The shape of a span: how long it is, what stands between its parts, and what stands before it.
SHAPES = (4, 4, 4)


def _shape(m: Column, before: Column) -> Column:
    n, last = F.char_length(m), F.right(before, F.lit(1))
    length = F.when(n < 12, 0).when(n < 17, 1).when(n < 24, 2).otherwise(3)
    between = F.when(F.rlike(m, F.lit("[()\\[\\]]")), 3).when(F.contains(m, F.lit(" ")), 2).when(F.rlike(m, F.lit("[-./_]")), 1).otherwise(0)
    ahead = F.when(last == "", 0).when(F.rlike(last, F.lit("\\s")), 1).when(F.rlike(last, F.lit("[\\p{L}\\p{N}]")), 2).otherwise(3)
    return (length * SHAPES[1] + between) * SHAPES[2] + ahead


def shape_parts(shape: int) -> tuple[int, int, int]:
    return shape // (SHAPES[1] * SHAPES[2]), shape // SHAPES[2] % SHAPES[1], shape % SHAPES[2]


def _candidates(kind: int, loose: bool, spans: Column) -> Column:
    """The spans of one pattern as candidates: votes, and the shape."""

    def make(x: Column) -> Column:
        ok = F.lit(False) if loose else _passes(kind, x["m"])
        around = F.concat(F.right(x["before"], F.lit(1)), x["after"])
        votes = F.array(*_votes(kind, ok, loose, x["m"], x["before"], around))
        return F.struct(x["start"], F.lit(kind).alias("k"), x["end"], ok.alias("ok"), F.lit(loose).alias("loose"), votes.alias("votes"), _shape(x["m"], x["before"]).alias("shape"))

    wanted = spans if loose else F.filter(spans, lambda x: _near_miss(kind, x["m"]))
    return F.transform(wanted, make).cast(f"array<{CANDIDATE}>")


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and the array of all its candidates."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    none = F.array().cast("array<string>")
    forms = [(k, loose, (LOOSE if loose else BASE)[k], (LOOSE_NEEDS if loose else NEEDS)[k]) for loose in (False, True) for k in range(4)]
    found = []
    for k, loose, pattern, needs in forms:
        all_ = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        for x in needs:
            all_ = F.when(F.contains("t", F.lit(x)), all_).otherwise(none)
        found.append(all_.alias(f"m{k}{int(loose)}"))
    rows = rows.select("doc_id", "t", *found)
    names = [f"{k}{int(o)}" for k, o, _, _ in forms]
    spans = [F.when(F.size(f"m{n}") > 0, _spans(F.split("t", p, -1), F.col(f"m{n}"))).otherwise(F.array().cast(f"array<{FOUND}>")).alias(f"s{n}") for n, (_, _, p, _) in zip(names, forms, strict=True)]
    rows = rows.select("doc_id", *spans)
    made = [F.when(F.size(f"s{n}") > 0, _candidates(k, o, F.col(f"s{n}"))).otherwise(F.array().cast(f"array<{CANDIDATE}>")) for n, (k, o, _, _) in zip(names, forms, strict=True)]
    return rows.select("doc_id", F.concat(*made).alias("found"))


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple, float]:
    """Probability that a candidate is real per (kind, votes), by expectation-maximisation.

    counts: (kind, votes, number). A labeler has its own chances of each vote
    for real and for false candidates of a kind, smoothed by one candidate.
    """
    out: dict[tuple, float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(v, n) for k, v, n in counts if k == kind]
        p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in own}
        for _ in range(rounds):
            total = sum(n for _, n in own)
            real = sum(p[v] * n for v, n in own)
            share = (real + 1) / (total + 2)
            chance = []
            for j in range(len(own[0][0])):
                tables = {}
                for y in (0, 1):
                    # a prior of a labeler that is right four times in five when it votes
                    mass = {1: 1.0 if y else 0.25, 0: 0.5, -1: 0.25 if y else 1.0}
                    for v, n in own:
                        mass[v[j]] += (p[v] if y else 1 - p[v]) * n
                    all_ = sum(mass.values())
                    tables[y] = {x: m / all_ for x, m in mass.items()}
                chance.append(tables)
            for v, _ in own:
                odds = math.log(share / (1 - share)) + sum(math.log(chance[j][1][x] / chance[j][0][x]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): q for v, q in p.items()}
    return out


def fit(patterns: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> dict[tuple, float]:
    """Weights of the span classifier by feature; patterns: (kind, votes, shape, number)."""
    sums: dict[tuple, int] = {}
    for kind, votes, _, n in patterns:
        sums[kind, votes] = sums.get((kind, votes), 0) + n
    target = estimate([(k, v, n) for (k, v), n in sums.items()])
    rows = [(features(k, v, s), target[k, v], n) for k, v, s, n in patterns]
    weights = {f: 0.0 for fs, _, _ in rows for f in fs}
    moment = dict.fromkeys(weights, 0.0)
    total = max(1, sum(n for _, _, n in rows))
    for _ in range(rounds):
        slope = {f: ridge * w for f, w in weights.items()}
        for fs, y, n in rows:
            q = 1 / (1 + math.exp(-sum(weights[f] for f in fs)))
            for f in fs:
                slope[f] += (q - y) * n / total
        for f in weights:
            moment[f] += slope[f] ** 2
            weights[f] -= rate * slope[f] / (math.sqrt(moment[f]) + 1e-9)
    return weights


def features(kind: int, votes: tuple[int, ...], shape: int) -> list[tuple]:
    return [("kind", kind), *(("shape", kind, j, v) for j, v in enumerate(shape_parts(shape))), *(("vote", kind, j, v) for j, v in enumerate(votes))]


def _score(x: Column, weights: dict[tuple, float]) -> Column:
    """The classifier's log odds of a candidate."""

    def pick(at: Column, values: list[float]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    get = lambda *f: weights.get(f, 0.0)
    total = pick(x["k"], [get("kind", k) for k in range(4)])
    shapes = SHAPES[0] * SHAPES[1] * SHAPES[2]
    total = total + pick(x["k"] * shapes + x["shape"], [sum(get("shape", k, j, v) for j, v in enumerate(shape_parts(s))) for k in range(4) for s in range(shapes)])
    for j in range(4):
        total = total + pick(x["k"] * 3 + F.get(x["votes"], j) + 1, [get("vote", k, j, v) for k in range(4) for v in (-1, 0, 1)])
    return total


SPAN = "struct<start:int,k:int,end:int>"
MARKED = "struct<start:int,k:int,end:int,loose:boolean,met:boolean>"


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of (start, k, end), k numbering KINDS, ends exclusive, code points."""
    made = materialize(candidates(documents), "candidates")
    counts = made.select(F.explode("found").alias("x")).groupBy("x.k", "x.votes", "x.shape").count()
    patterns = sorted((r["k"], tuple(r["votes"]), r["shape"], r["count"]) for r in counts.collect())
    weights = fit(patterns)
    bare = lambda x: F.struct(x["start"], x["k"], x["end"]).cast(SPAN)
    base = F.array_sort(F.transform(F.filter("found", lambda x: x["ok"]), bare))
    more = F.filter("found", lambda x: x["loose"] & (_score(x, weights) >= 0))
    rows = made.select("doc_id", base.alias("base"), more.alias("more"))
    mark = lambda x, loose: F.struct(x["start"], x["k"], x["end"], F.lit(loose).alias("loose"), F.lit(False).alias("met")).cast(MARKED)
    both = F.array_sort(F.concat(F.transform("base", lambda x: mark(x, False)), F.transform("more", lambda x: mark(x, True))))
    none = F.array().cast(f"array<{MARKED}>")

    def step(meets: Callable[[Column, Column], Column], carry: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        def run(acc: Column, x: Column) -> Column:
            now = F.struct(x["start"], x["k"], x["end"], x["loose"], (x["met"] | meets(acc["s"], x)).alias("met")).cast(MARKED)
            return F.struct(F.when(x["loose"], acc["s"]).otherwise(carry(acc["s"], x)).alias("s"), F.concat(acc["o"], F.array(now)).alias("o"))

        return run

    # what a base span before reaches, then, from the end, what one behind begins in
    rows = rows.select("doc_id", "base", F.size("more").alias("n"), both.alias("both"))
    forth = _scan(F.col("both"), F.lit(-1), none, step(lambda s, x: s > x["start"], lambda s, x: F.greatest(s, x["end"])))
    rows = rows.select("doc_id", "base", "n", F.when(F.col("n") > 0, F.reverse(forth)).otherwise(none).alias("both"))
    far = F.lit(2**31 - 1)
    back = _scan(F.col("both"), far, none, step(lambda s, x: s < x["end"], lambda s, x: F.least(s, x["start"])))
    rows = rows.select("doc_id", "base", F.when(F.col("n") > 0, F.filter(F.reverse(back), lambda x: x["loose"] & ~x["met"])).otherwise(none).alias("free"))

    def take(acc: Column, x: Column) -> Column:
        fits = x["start"] >= acc["s"]
        return F.struct(F.when(fits, x["end"]).otherwise(acc["s"]).alias("s"), F.when(fits, F.concat(acc["o"], F.array(bare(x)))).otherwise(acc["o"]).alias("o"))

    added = _scan(F.col("free"), F.lit(0), F.array().cast(f"array<{SPAN}>"), take)
    return rows.select("doc_id", "base", added.alias("added"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir):
    spans = find(table(spark, sf_dir, "documents"))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
