"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import TUNING

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which the driver and all executors reach.

    Only a local session may lack the setting; it gets a folder of its own for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Keep the batches sent to Python as small as ``session.tune`` does, in a session that the caller built, too.

    Spark's own limits are 10,000 rows and 64 MB. A batch of texts stands in the JVM's direct memory and in Python, several
    times as it grows and is copied.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, TUNING[key])


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character, accented capitals included, stays."""
    return F.translate(c, UPPER, LOWER)


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Tell repeated rows apart. The number depends on the input's files only, so a retried task repeats it."""
    return df.withColumn(name, F.monotonically_increasing_id())


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows, counted no further than that."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark a narrow table for broadcasting if it has at most ``rows`` rows, else leave the join to shuffle."""
    return F.broadcast(df) if fits(df, rows) else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have."""
    while stem.lower() in map(str.lower, df.columns):
        stem += "_"
    return stem


# A key that holds more than one row in this many is joined by broadcast: there are fewer such keys than this number.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups, of which some may hold a large part of all rows.

    ``groups`` has one row per key with the number of its rows in ``size``; ``total`` is the sum of these. Fewer than
    ``HOT_SHARE`` groups can hold more than ``total / HOT_SHARE`` rows each: those are broadcast, whatever the size of
    the table, and their rows stay in place. All others are shuffled, and none of them is large.
    """
    is_hot = F.col(size) * HOT_SHARE > total
    hot, cold = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    rest = rows.join(F.broadcast(groups.where(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))
