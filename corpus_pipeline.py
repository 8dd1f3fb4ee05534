"""A training-data pipeline over `documents`: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, read_table, written
from tidewatch.llm.forest import drop_near_duplicates
from tidewatch.llm.langid import MIN_SCORE, UNKNOWN, predicted, train_on_documents
from tidewatch.llm.lines import dedup_lines, line_classes
from tidewatch.llm.mixing import mixed_documents
from tidewatch.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is likely enough, go."""
    model = train_on_documents(docs)
    if not model.langs:
        return docs
    name = fresh(docs, "language_found")
    found = docs.withColumn(name, predicted(model, F.col("text"), spark))
    likely = (F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= MIN_SCORE)
    return found.where(likely).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; each document stays, in SQL functions only.

    Near copies by their lines count as one document, so a copied text keeps its lines for `near_dedup`, which leaves
    one copy of it. Nulls come back as empty texts, empty tables as such; repeated rows, null ids and other columns stay.
    """
    return dedup_lines(docs, classes=written(line_classes(docs), "line-classes")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources have their target weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words lie in sequences of bounded length."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL can't express the model, the near-duplicate groups or best fit; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
