"""Training sets and audit logs as CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CLASSIFICATION_LOG, CLASSIFIED_LOG, RUN_STATS, TRAINING_ROW

# Quotes inside a field are doubled, not escaped with a backslash.
_CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema).csv(path)


def read_dataset_csv(spark: SparkSession, path: str, schema: str = TRAINING_ROW) -> DataFrame:
    """Training rows that have a label."""
    return read_csv(spark, path, schema).na.fill("").where(F.col("label") != "")


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLASSIFICATION_LOG)


def read_classified_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, CLASSIFIED_LOG)


def read_run_stats_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RUN_STATS)


def write_dataset_json(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Training rows as JSON lines and the one-row summary next to them, so that all tasks can write."""
    rows.write.mode("overwrite").json(f"{path}/emails")
    summary.write.mode("overwrite").json(f"{path}/metadata")


def read_dataset_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Training rows from JSON documents, each a list of rows or an object with an ``emails`` list.

    ``lines`` reads files with one row per line, which can be split between tasks.
    """
    if lines:
        return spark.read.schema(TRAINING_ROW).json(path)
    documents = spark.read.schema(f"{TRAINING_ROW}, emails array<struct<{TRAINING_ROW}>>").option("multiLine", True).json(path)
    fields = [c for c in documents.columns if c != "emails"]
    single = F.array(F.struct(*fields))
    # A row of a list has no "emails"; an object without it holds no rows.
    is_row = F.coalesce(*fields[:-2], "source_folder").isNotNull()
    rows = F.coalesce("emails", F.when(is_row, single))
    return documents.select(F.inline(rows))
