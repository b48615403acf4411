"""A training corpus from raw documents: toxic texts out, one of each group of near copies, repeated passages out, packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() writes every stage's rows to
the shared folder and reads them back for the next. The result is one row for each piece of a packed document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import packing, resemblance, suffix_dedup, toxicity
from vecloom.llm.common import materialize
from vecloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below one half, as they are."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (SimHash links, and five-word shingles at 0.8 or more), as it is."""
    ship(spark)
    return resemblance.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that stand elsewhere, too; n_chars counts what is left."""
    ship(spark)
    return suffix_dedup.strip_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4,096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: SimHash components and bin completion are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
