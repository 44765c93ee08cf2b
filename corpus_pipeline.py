"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, encoding; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.llm import mixing, pieces, secrets, simhash, toxicity
from grainflow.llm.common import discard, materialize, table
from grainflow.llm.queries import TOXIC, held_out, vocabulary

#: No SQL: the toxicity model is trained and the encoding needs a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model of the labelled ones rejects."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model, keep=True).where(F.col("score") < TOXIC).select("doc_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of texts that op10 links by their fingerprints, or that share 0.8 of their
    five-word shingles or more; rows that repeat it are one. Without any id the rows of a class that differ all go on."""
    found = simhash.near_duplicates(docs, share=0.8, words=5)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component"))).groupBy("doc_id").agg(F.count("*").alias("rows"))
    once, repeated = (materialize(first.where(c).select("doc_id"), "kept-ids") for c in ("rows = 1", "rows > 1"))
    of = lambda ids: docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    # whole rows are compared only where an id repeats
    return of(once).unionByName(of(repeated).dropDuplicates())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; n_chars follows."""
    found = secrets.scan(docs, secrets.train(docs), keep=True)
    text = F.when(F.size("spans") > 0, secrets.masked(F.col("text"), F.col("spans"))).otherwise(F.col("doc_row.text"))
    out = found.select(text.alias("text"), "doc_row")
    n = F.when(out["text"].eqNullSafe(out["doc_row.text"]), out["doc_row.n_chars"]).otherwise(F.length(out["text"]).cast("long"))
    cols = {"text": out["text"], "n_chars": n}
    return out.select(*(cols.get(c, out[f"doc_row.{c}"]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples the documents so that the sources come to their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        later = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return later
        later = materialize(later, name)
        discard(docs)
        docs = later
    return docs
