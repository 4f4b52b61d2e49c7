"""Held-out accuracy of the trained classifiers, and the pipeline end to end."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import quality, registry, toxicity, training

SF = "/root/testdata/sf0.001"


def labelled(spark, n=900):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioubdgklmnprstv") for _ in range(r.randrange(2, 9))) for _ in range(600)]
    bad = ["zorgix", "qwembo", "hyzzarp"]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(15, 80))]
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.8)
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(bad)
        text = " ".join(words)
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(f"{words[0]}" for _ in range(40))])
            toxic = toxic and int(any(b in text.lower() for b in bad))
        rows.append((i, text))
        labels.append((i, good, toxic))
    documents = spark.createDataFrame([*rows, (-1, None), (-2, ""), (None, "x")], "doc_id long, text string")
    return documents, spark.createDataFrame([*labels, (-5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(rows, label):
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity(spark):
    documents, labels = labelled(spark)
    model = toxicity.train(documents, labels)
    scored = toxicity.score(documents.withColumn("toxicity", F.lit("clashing")), model).withColumn("predicted", (F.col("toxicity") >= 0.5).cast("int"))
    assert scored.count() == documents.count() and scored.where("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    held = scored.join(labels, "doc_id").where(training.remainder("doc_id", 5) == 0).collect()
    assert len(held) > 100 and accuracy(held, "toxic") >= 0.97
    hidden = ["zorrgix", "z.o.r.g.i.x", "z o r g i x", "ZORGIX!", "zor-gix", "qwembbo"]
    calm = ["", "tomorrow", "a b", "12345", None]
    assert (model.scores(pa.array(hidden)) >= 0.5).all() and (model.scores(pa.array(calm)) < 0.5).all()
    assert toxicity.score(documents.limit(0), model).count() == 0
    none = toxicity.train(documents, labels.limit(0))
    assert none.scores(pa.array(["x", None])).tolist() == [0, 0]


def test_quality(spark):
    documents, labels = labelled(spark)
    model = quality.train(documents, labels)
    scored = quality.score(documents, model).withColumn("predicted", (F.col("quality") >= 0.7).cast("int")).withColumnRenamed("quality", "value")
    held = scored.join(labels, "doc_id").where(training.remainder("doc_id", 4) == 2).collect()
    assert len(held) > 100 and accuracy(held, "quality") >= 0.97
    assert scored.count() == documents.count() and scored.where("value is null or value < 0 or value > 1").count() == 0
    assert quality.train(documents, labels.limit(0)).scores(pa.array(["x"])).tolist() == [0]


def plain_toxicity(model, text):
    """A text's score letter by letter: words, runs of single letters as one word, all subsequences of three letters."""
    found, run = [], []
    for w in [*(text or "").encode().split(), b"  "]:
        if len(w) == 1 and toxicity._LETTERS[w[0]]:
            run.append(w)
        else:
            found += [b"".join(run)] if len(run) >= 3 else []
            run = []
        found.append(w)
    best = toxicity.LOWEST
    for w in found[:-1]:
        u = [toxicity.BEGIN, *(int(toxicity._LETTERS[c]) for c in w if toxicity._LETTERS[c])]
        total = square = 0.0
        for i in range(len(u)):
            for d in toxicity.STEPS:
                for e in toxicity.STEPS:
                    if i + d + e < len(u):
                        weight = toxicity.DECAY ** (d + e - 2)
                        total += weight * float(model.weights[u[i] << 12 | u[i + d] << 6 | u[i + d + e]])
                        square += weight**2
        best = max(best, total / max(square, toxicity.DECAY**8) ** 0.5 + model.bias)
    return 1 / (1 + np.exp(-(model.slope * best + model.offset)))


def test_toxicity_against_a_plain_reading(spark):
    documents, labels = labelled(spark, 400)
    model = toxicity.train(documents, labels)
    texts = [r["text"] for r in documents.limit(120).collect()] + [None, "", " \t", "a b c zorgix", "z o r g i x", "z.o-r g!x", "x" * 3000, "z o"]
    got = model.scores(pa.array(texts))
    assert got == pytest.approx([plain_toxicity(model, t) for t in texts], abs=1e-9)


def test_quality_against_a_plain_reading(spark):
    """The score from the model's tables, and that the scores rank the labelled pairs as the pairs say."""
    documents, labels = labelled(spark, 400)
    model = quality.train(documents, labels)
    rows = documents.join(labels, "doc_id").where("text is not null").collect()
    texts = [r["text"] for r in rows]
    values = quality.features(pa.array(texts))
    got = model.scores(pa.array(texts))
    for x, score in zip(values.tolist(), got.tolist(), strict=True):
        rank = sum(model.weights[j][sum(1 for c in model.cuts[j] if c <= v)] for j, v in enumerate(x))
        assert score == pytest.approx(1 / (1 + np.exp(-(rank - model.threshold + np.log(0.7 / 0.3)))), abs=1e-9)
    good, bad = (np.array([s for s, r in zip(got, rows, strict=True) if r["quality"] == v]) for v in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.97


def test_quality_is_fitted_on_all_rows(spark, monkeypatch):
    """Every usable labelled row takes part in the cuts, the pairs and the threshold."""
    documents, labels = labelled(spark, 400)
    want = documents.select("doc_id").distinct().join(labels.where("quality is not null"), "doc_id").where(training.remainder("doc_id", 4) != 2).select("doc_id").distinct().count()
    seen, fit = [], quality.fit
    bounds, rows = [], quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda *a: bounds.append(a[4:]) or rows(*a))
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(len(a[-1])) or fit(*a))
    model = quality.train(documents, labels)
    assert bounds == [(None,)] and seen[0] >= want > 50
    assert training.fit_rows(documents, labels, "quality", training.remainder("doc_id", 4) != 2, None).count() == seen[0]
    assert len(model.cuts) == 21


def test_quality_over_all_pairs():
    """The weights are those of the plain loss over every pair."""
    r = np.random.default_rng(5)
    y = (r.random(60) < 0.4).astype(np.uint8)
    codes = np.stack([np.clip(r.integers(0, 3, 60) + (k == 0) * y, 0, 2) for k in range(2)]).astype(np.uint8)
    model = quality.fit(np.array([[0.5, 1.5]] * 2), codes, y, 3000, 0.05)
    w = np.zeros((2, 3))
    for _ in range(3000):
        s = w[0][codes[0]] + w[1][codes[1]]
        miss = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
        own = np.zeros(60)
        own[y == 1], own[y == 0] = miss.mean(axis=1) / (y == 1).sum(), -miss.mean(axis=0) / (y == 0).sum()
        w += 0.5 * (np.stack([np.bincount(c, own, 3) for c in codes]) - 0.05 * w)
    assert model.weights == pytest.approx(w, abs=5e-3)


def test_fitting_sample_is_bounded(spark):
    documents, labels = labelled(spark, 200)
    assert training.fit_rows(documents, labels, "toxic", F.lit(True), 50).count() == 50


@pytest.mark.parametrize("name", sorted(registry.MODULES))
def test_contract_columns(spark, name):
    frame = registry.queries()[name](spark, SF)
    want = {
        "op2": "doc_id held_out score predicted", "op3": "query_id rank vec_id score", "op4": "doc_id n_shingles component_id", "op5": "doc_id held_out score predicted",
        "op6": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op10": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    }
    columns = want.get(name.split("_")[0], "doc_id").split()
    assert frame.columns[: len(columns)] == columns and frame.count() > 0


def test_pipeline(spark):
    import corpus_pipeline as P

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    extra = documents.withColumn("extra", F.lit(1)).union(documents.limit(2).withColumn("extra", F.lit(2))).unionByName(spark.createDataFrame([(None, None, None, None, None, 3), (10**9, "", "en", "s", 0, 4)], documents.withColumn("extra", F.lit(1)).schema))
    docs = extra
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == extra.columns, name
        docs = made
    assert 0 < docs.count() < extra.count() and docs.where("doc_id is null").count() == 1 and docs.where("extra = 4").count() == 1
    out = P.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = documents.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline as P

    names = ["_id", "_gone", "_toxicity", "toxicity", "gone", "a", "component", "rep", "sig"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        wrong = made.where(" or ".join(f"`{n}` <> concat('{n} ', doc_id)" for n in names))
        assert made.count() > 0 and wrong.isEmpty(), name
        docs = made
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0
