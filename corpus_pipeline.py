"""Corpus pipeline: language ID, toxicity, SimHash near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage
before it kept; all but the last return the columns of ``documents``.  A
stage's result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm import decontamination, langid, packing, simhash, toxicity
from vigilspark.session import store


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language of the corpus; letterless and unrecognisable ones go."""
    return langid.keep_recognised(docs, langid.learn(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of every group of fingerprints linked at 3 bits or fewer."""
    return simhash.drop_near_duplicates(docs, words=3, max_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half of any benchmark item or more."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document left in sequences of 4096 tokens."""
    return packing.pack(docs, capacity=4096, end_id=1)


STAGES = [
    ("language_id", recognised_language),
    ("toxicity", not_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No stage can be had from SQL over the tables; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
