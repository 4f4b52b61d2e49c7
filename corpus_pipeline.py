"""The corpus pipeline: each stage's rows are written as Parquet and reread by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of ``documents``, extra ones
included whatever their names; the last returns the pieces of packed
sequences. Empty tables, null and empty texts pass through every stage; texts
of any length are worked on whole. Rows without a doc_id are judged by their
own text in the first stage and stay in the three after it. Rows that repeat a
doc_id count as one document where a stage compares documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, jaccard, lines, pack, toxicity
from tidegrid.llm.common import free_name, materialize, maybe_broadcast, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those ids; rows without an id stay."""
    name = free_name(docs, "gone")
    gone = maybe_broadcast(materialize(ids.distinct().toDF(name), "gone"), 16)
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; each row by its own text, so repeated rows fare alike. A score of 0.5 is toxic."""
    name = free_name(docs, "toxicity")
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier document or line has; a document goes if nothing is left of it.

    Of equal lines the one of the least (doc_id, line number) stays.
    """
    return lines.drop_lines(docs, materialize(lines.duplicate_lines(docs, line_hash=True), "drops"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the least id stays.

    Of rows that repeat an id and a text one stays. Documents without a word
    are near nothing and stay.
    """
    found = materialize(jaccard.components(docs, 5, 80), "groups")
    kept = _without(docs, found.where("doc_id <> component_id").select("doc_id"))
    single = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return kept if single else kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id is null"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, with all rows of their id; any one overlap is enough, wherever it stands."""
    return _without(docs, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token sequences, piece by piece."""
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near duplicates", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", packing),
]

#: No SQL expresses training, packing or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
