"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Language ID, near-dedup, secret masking and mixing return the columns of documents; packing returns token pieces.
Cases: a null text is rejected by language ID (no language), null ids are documents by their text; repeated rows share their
document's verdict in each stage; an empty table gives an empty table at every stage; a very long text is worked on whole;
further columns, of whatever names, are carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import language, mixing, neardup, packing, secrets
from weftgraph.llm.common import discard, materialize

#: A prediction of less posterior than this is no language that the corpus is to hold.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages, with enough posterior; the rest go."""
    model = language.fit(docs)
    return language.select_known(docs, model, LEAST_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return neardup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secrets.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their fitted rate says, its fraction drawn by a hash of the id; the toxic domain's target is nothing."""
    return mixing.apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Sketches, regression and tokens aren't expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name)
            discard(before)
    return docs
