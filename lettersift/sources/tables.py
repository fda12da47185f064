"""Log and state tables as parquet folders with one version per batch.

A batch overwrites its own version and reads only earlier ones, so running it again after a failure
gives the same tables.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RECENT_HASHES, WATERMARK
from . import manifests

# Every so many batches the whole state is written, so that reading it does not take longer and longer.
SNAPSHOT_EVERY = 50
STATE = (
    "mailbox string, newest struct<hash:string,date:string,subject:string,received_at:timestamp>, "
    "recent array<struct<hash:string,batch_id:bigint,seq:bigint>>"
)
_MANIFEST = "version bigint, parent bigint, snapshot boolean, files array<string>"


def write_version(df: DataFrame, path: str, version: int, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/version={version}")


def versions_of(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[int]]:
    """A table with its column ``version``, and the versions there are. One that does not exist yet is empty."""
    full = f"{schema}, version bigint"
    try:
        rows = spark.read.schema(full).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full), []
    found = {int(m[1]) for f in rows.inputFiles() if (m := re.search(r"/version=(\d+)/", f))}
    return rows, sorted(found)


def state_rows(marks: DataFrame, recent: DataFrame) -> DataFrame:
    """One row per mailbox, so that watermark and keys are committed by one write."""
    lists = recent.groupBy("mailbox").agg(F.collect_list(F.struct("hash", "batch_id", "seq")).alias("recent"))
    newest = marks.select("mailbox", F.struct("hash", "date", "subject", "received_at").alias("newest"))
    return lists.join(newest, "mailbox", "full").select("mailbox", "newest", "recent")


def is_snapshot(version: int) -> bool:
    """Versions that hold every mailbox; the others hold those a batch changed."""
    return version % SNAPSHOT_EVERY == 0


def latest_state(versions: DataFrame) -> DataFrame:
    """The last row of each mailbox."""
    latest = versions.groupBy("mailbox").agg(F.max_by(F.struct("newest", "recent"), "version").alias("_row"))
    return latest.select("mailbox", "_row.*")


def write_state(df: DataFrame, path: str, version: int) -> None:
    """Write one version of the state and commit it with a manifest: its files and those it rests on.

    A version rests on the newest snapshot and the versions since. With a snapshot, versions older than the last two
    snapshots are removed, so the table keeps its size however many batches there are.
    """
    spark = df.sparkSession
    manifests.withdraw(spark, path, version)
    write_version(df, path, version)
    files = spark.read.parquet(f"{path}/version={version}").inputFiles()
    parent = None
    if not is_snapshot(version):
        parent = _state_manifest(spark, path, version)
        files = [*(parent.files if parent else []), *files]
    row = (version, parent.version if parent else None, is_snapshot(version), files)
    manifests.commit(spark.createDataFrame([row], _MANIFEST), path, version)
    if is_snapshot(version):
        oldest = version - SNAPSHOT_EVERY
        for old in manifests.versions(spark, path):
            if old < oldest:
                manifests.withdraw(spark, path, old)
                manifests.remove(spark, f"{path}/version={old}")


def _state_manifest(spark: SparkSession, path: str, before: int | None):
    """The manifest that state before a version rests on; None if there is no version before it."""
    version = None if before is None else before - 1
    if version is None or version < 0:
        known = manifests.versions(spark, path)
        if before is not None or not known:
            return None
        version = known[-1]
    found = manifests.manifest(spark, path, version, _MANIFEST)
    if found is None and any(v < version for v in manifests.versions(spark, path)):
        raise ValueError(f"state version {version} is missing in {path}")
    return found.first() if found is not None else None


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """State after the last version, or before version ``before``.

    Opens the files that one manifest lists: the newest snapshot and the versions after it. If a version is missing, state
    would be lost without a sign, so that is an error; only a table that does not exist is empty. Tables without
    manifests are read by their folders.
    """
    if manifests.names(spark, f"{path}/_manifests"):
        found = _state_manifest(spark, path, before)
        if found is None:
            return latest_state(spark.createDataFrame([], f"{STATE}, version bigint"))
        rows = spark.read.schema(f"{STATE}, version bigint").option("basePath", path).parquet(*found.files)
        return latest_state(rows)
    rows, versions = versions_of(spark, path, STATE)
    end = before if before is not None else (versions[-1] + 1 if versions else 0)
    if not versions or not end:
        return latest_state(rows.where(F.lit(False)))
    snapshots = [v for v in versions if v < end and is_snapshot(v)]
    first = snapshots[-1] if snapshots else (end - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    missing = sorted(set(range(first, end)) - set(versions))
    if missing:
        raise ValueError(f"state versions {missing} are missing in {path}")
    return latest_state(rows.where((F.col("version") >= first) & (F.col("version") < end)))


def marks_of(state: DataFrame) -> DataFrame:
    marks = state.where(F.col("newest").isNotNull()).select("mailbox", "newest.*")
    return marks.select(*[f.split()[0] for f in WATERMARK.split(", ")])


def recent_of(state: DataFrame) -> DataFrame:
    rows = state.select("mailbox", F.inline("recent"))
    return rows.select(*[f.split()[0] for f in RECENT_HASHES.split(", ")])


def write_log(df: DataFrame, path: str, batch_id: int, day: str = "saved_at") -> None:
    """Write the log rows of a batch in folders by mailbox and day, which reads and retention can skip.

    A batch that is run again replaces its own rows.
    """
    write_version(df.withColumn("saved_date", F.to_date(F.col(day))), path, batch_id, ("mailbox", "saved_date"))
