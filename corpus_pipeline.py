"""The training-data pipeline over ``documents``: filter, clean and pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the stage before kept. All but the last return the
columns of ``documents``; rows without text or ``doc_id`` and repeated rows pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettersift.llm.common import free_name, saved, small_side, table
from lettersift.llm.decontamination import decontaminate
from lettersift.llm.near import drop_near_duplicates
from lettersift.llm.packing import pack
from lettersift.llm.secrets import redact
from lettersift.llm.toxicity import score_toxicity

# Keys of rejected rows that are broadcast at most: 16 bytes each.
BROADCAST_DOCUMENTS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each by its own text."""
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    scored = score_toxicity(keyed, table(spark, sf_dir, "labels"), carry=(key,))
    rejected = saved(scored.where(F.col("predicted") == 1).select(key).distinct(), "rejected")
    return keyed.join(small_side(rejected, BROADCAST_DOCUMENTS), key, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, likeness 0.8 or more."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of training sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]
# The toxicity classifier is trained, which SQL can't express; the tests check each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
