"""A pipeline over the table documents: quality, near-duplicates, repeated substrings, source mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written as Parquet and
read again. All but the last return the columns of documents. Null and empty texts pass every stage as the operators
define it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import bpe, fmindex, mixing, quality, runtime, simhash

#: Passes over a source at most; every document is passed over once at least.
PASSES = 2.0

#: A classifier's fit and graph components are beyond SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    runtime.prepare(spark)
    model = quality.fit(*quality.training_rows(docs, runtime.table(spark, sf_dir, "labels")))
    marked = quality.classify(docs, model, docs.columns, ("_score", "_predicted"))
    return marked.where("_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; documents that lose all their words go."""
    return fmindex.dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture passes over it, once at least."""
    mixed = mixing.mix(docs, passes=PASSES, whole=True)
    rows = mixed.withColumn("_pass", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of their decoding."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("substrings", unrepeated_text),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
