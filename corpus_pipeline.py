"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it as Parquet and read it back
before the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm.base import materialize, table
from cityweave.llm.kneser import keep_accepted
from cityweave.llm.neardup import drop_near_copies
from cityweave.llm.packing import pack
from cityweave.llm.superkmer import without_repeats
from cityweave.llm.wumanber import clean


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of too high a perplexity go.

    Null and empty texts go; a null language is a language of its own; repeated rows are judged alike; rows of a null id stay
    or go by their text; without trusted labels all texts with a character stay; an empty table gives an empty table."""
    return keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id.

    Of equal ids that of the smallest text hash stays, of equal rows one; a null id only where a group has no other. Null text
    counts as empty, and texts without words are copies of each other; an empty table gives an empty table."""
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; n_chars, where docs has it, follows.

    Null and short texts stay as they are; rows of equal id and text are one document, returned as often as it occurs; a null
    id comes after all others; no row goes; an empty table gives an empty table."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts stay; repeated rows stay or go together; items with a null id or text match nothing; an empty
    benchmark or table takes nothing out."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, each with its place in a sequence.

    A null or empty text is its end token; repeated rows are packed as often as they occur; an empty table gives none."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]
#: The stages' verdicts rest on trained models and hashes that SQL doesn't have; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
