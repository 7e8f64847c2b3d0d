"""Corpus preparation over ``documents``: five stages, each written and read again.

In every stage null texts count as empty, rows that repeat are judged each by the
same rule, ties go by identifier or hash, an empty table gives an empty one, very
long texts are read whole, and columns that ``documents`` hasn't are passed
through, whatever their names (but for ``piece_ids``, which the last stage makes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbatrix.llm import exact_dedup, mixing, sentencepiece_fst, simhash, toxicity
from verbatrix.llm.common import remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on ``docs`` and ``labels``, doesn't reject.

    Empty and null texts get the model's bias and stay where most labels are 0;
    repeated rows share their fate; without labels all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts differ in white space at most.

    The smallest identifier stays, a null one last; null and empty texts are one
    group; of rows that are equal one stays.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: 5-word shingles, similarity 0.8 or more.

    The smallest identifier stays, a null one last; texts without a word all stay.
    """
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null is a source; a document without a word is taken as often as its source is
    whole; rows that are equal are taken equally often.
    """
    return mixing.apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text, in the place of the text; none for null and empty ones."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the stages with models, fingerprints and piece encodings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again; the last of them stay there."""
    base = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            remove(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
