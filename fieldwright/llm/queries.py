"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam
from . import phrases as phrase_mining
from .common import table
from .decontam import contamination
from .embeddings import embedding_components
from .language import language_predictions
from .pii import personal_data
from .phrases import phrases
from .pieces import encoded_and_decoded
from .quality import quality_scores
from .secret_scan import secrets
from .shards import sharded_documents
from .simhash import simhash_components
from .sstable import encoded_documents
from .toxicity import toxicity_scores
from .whitening import whitened_embeddings


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept rows of all embeddings. See embedding_components for null, odd and repeated rows."""
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op2_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. See language_predictions for null, empty and long texts."""
    return language_predictions(table(spark, sf_dir, "documents"))


def op3_sstable_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as tables and read back. See encoded_documents for odd rows."""
    return encoded_documents(table(spark, sf_dir, "documents"))


def op4_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. See personal_data for odd rows."""
    return personal_data(table(spark, sf_dir, "documents"))


def op5_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document. See toxicity_scores for odd rows and labels."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. See simhash_components for odd rows."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document. See contamination for odd rows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document. See quality_scores for odd rows and labels."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. See sharded_documents for odd rows."""
    return sharded_documents(table(spark, sf_dir, "documents"))


def op10_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, decoded again. See encoded_and_decoded for odd rows."""
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def op11_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document. See secrets for odd rows."""
    return secrets(table(spark, sf_dir, "documents"))


def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every embedding. See whitened_embeddings for odd rows; a deviation past 64 bits fails the cast."""
    return whitened_embeddings(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_debruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language of all documents. See phrases for odd rows."""
    return phrases(table(spark, sf_dir, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
ORACLE_SQL: dict[str, str] = {"op7_benchmark_decontamination": decontam.ORACLE, "op13_debruijn_phrases": phrase_mining.ORACLE}
