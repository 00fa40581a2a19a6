"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm import (attribution, classlm, conversation_trie, decontamination, embedding_join, langid, packing, quality, simhash, sql,
                            term_scan, token_store, toxicity, urlfilter)
from vigilspark.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"), folds=3, held_out=1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds benchmark items, for every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to a token store and read back from it."""
    path = f"{checkpoint_dir(spark)}/vigil-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_store.read_store(spark, path)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based bigram score of every document, learned from the folds that are not held out."""
    return classlm.score(table(spark, sf_dir, "documents"), folds=7, held_out=2)


def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector at cosine 0.98 or more."""
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.98)


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of every document."""
    return attribution.count_sections(table(spark, sf_dir, "documents"), rule="majority")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return term_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return conversation_trie.node_table(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_store": op2_token_store,
    "op3_class_lm": op3_class_lm,
    "op4_simhash": op4_simhash,
    "op5_embedding_join": op5_embedding_join,
    "op6_url_filter": op6_url_filter,
    "op7_token_attribution": op7_token_attribution,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_rules": op13_quality_rules,
}

#: The others can't be had from SQL over the tables alone; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_embedding_join": sql.EMBEDDING_JOIN,
    "op6_url_filter": sql.URL_FILTER,
    "op11_ranked_search": sql.TERM_SCAN,
    "op12_prefix_trie": sql.conversation_trie(),
    "op13_quality_rules": sql.quality_rules(),
}
