"""The pipeline over documents: five stages, each an operator of fieldwright.llm on all that the stage before kept.

1. quality: rows that the naive Bayes support vector classifier rejects (score under 0.3) go.
2. near_copies: one row stays of each group of near copies (exactly 0.8 or more on five-word shingles).
3. benchmark: rows in which a ten-word window of a benchmark item occurs go.
4. personal_data: e-mail addresses, IP addresses, card and phone numbers become <email>, <ip>, <card>, <phone>.
5. pieces: SentencePiece ids of every text, with the check that decoding gives the text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldwright.llm.common import new_dir, remove_dir, table
from fieldwright.llm.decontam import drop_contaminated
from fieldwright.llm.pieces import encoded_and_decoded
from fieldwright.llm.pii import mask_personal_data
from fieldwright.llm.quality import drop_low_quality
from fieldwright.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is at least 0.3 stay as they are. Null and empty texts are scored too; without usable labels all have one score."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays as it is; null and empty texts and rows without id stay."""
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of an item stay as they are; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; personal data in texts is replaced by its kind, null texts stay null."""
    return mask_personal_data(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a row: doc_id, ids and what tells that decoding gives the text again; a null text counts as empty."""
    return encoded_and_decoded(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: Classifier, near copies and field have no SQL form; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. Each one's rows are written to the shared folder and read again by the next, after which the
    folder goes; that of the last but one stays, as the result reads it. Empty tables give an empty result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_dir(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
