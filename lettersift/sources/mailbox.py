"""A mailbox table that is changed folder by folder.

Rows lie in folders by version, mailbox and source folder. A manifest says which version holds each (mailbox, folder); a change
rewrites only those it touches, under a new version, and all others keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decide import apply_actions
from ..rules import ALL_MAIL
from ..schemas import KEY
from . import manifests

_MANIFEST = "mailbox string, source_folder string, held_by bigint"
_PARTS = ["mailbox", "source_folder"]


def _written(rows: DataFrame, path: str, version: int) -> DataFrame:
    """Write rows under a version and return the parts it holds. Each part is one sorted run of files."""
    rows.repartition(*_PARTS, F.pmod(F.xxhash64("uid"), F.lit(8))).write.mode("overwrite").partitionBy(*_PARTS).parquet(
        f"{path}/data/version={version}")
    data = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data/version={version}")
    return data.select(*_PARTS).distinct().withColumn("held_by", F.lit(version).cast("long"))


def create_mailbox(rows: DataFrame, path: str) -> None:
    """Write the first version. Rows need ``mailbox, source_folder, uid``, none of them null."""
    manifests.withdraw(rows.sparkSession, path, 0)
    manifests.commit(_written(rows, path, 0), path, 0)


def _parts_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    found = manifests.manifest(spark, path, version, _MANIFEST)
    if found is None:
        raise ValueError(f"mailbox version {version} is missing in {path}")
    return found


def _rows(spark: SparkSession, path: str, parts: DataFrame, schema) -> DataFrame:
    """The rows of some parts; files of other parts are not opened."""
    held = sorted(r.held_by for r in parts.select("held_by").distinct().collect())
    full = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, version bigint"
    if not held:
        return spark.createDataFrame([], full).drop("version")
    data = spark.read.schema(full).option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}" for v in held])
    keys = parts.select(*_PARTS, F.col("held_by").alias("version"))
    return data.join(keys, [*_PARTS, "version"], "left_semi").drop("version")


def read_mailbox(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """All rows of a version, the newest if none is named."""
    version = manifests.versions(spark, path)[-1] if version is None else version
    return _rows(spark, path, _parts_of(spark, path, version), schema)


def update_mailbox(spark: SparkSession, path: str, plan: DataFrame, version: int, schema) -> DataFrame:
    """Carry out a plan as a new version and return the parts that were rewritten.

    Touched are the folders of applied steps and, of archived messages, the all-mail folder. A folder that is left
    empty has no part any more. Running a version again starts from the version before it and replaces it, so it changes
    nothing. Old versions stay readable until ``drop_versions``.
    """
    before = _parts_of(spark, path, version - 1)
    manifests.withdraw(spark, path, version)
    # A plan can be costly: it is carried out once, and what it applies is kept until the version is committed.
    kept = f"{path}/steps/version={version}"
    steps = plan.where("apply").select(*KEY, "planned_action", "planned_label", "apply")
    steps.write.mode("overwrite").parquet(kept)
    steps = spark.read.schema(steps.schema).parquet(kept)
    touched = steps.select(*_PARTS).union(
        steps.where(F.col("planned_action") == "archive").select("mailbox", F.lit(ALL_MAIL).alias("source_folder"))).distinct()
    old = _rows(spark, path, before.join(touched, _PARTS, "left_semi"), schema)
    new = _written(apply_actions(old, steps).select(*[f.name for f in schema]), path, version)
    manifests.commit(before.join(touched, _PARTS, "left_anti").unionByName(new), path, version)
    manifests.remove(spark, kept)
    return new


def drop_versions(spark: SparkSession, path: str, before: int) -> list[int]:
    """Remove the manifests before a version, and the data that none of the others names. Returns the data versions removed."""
    known = manifests.versions(spark, path)
    for version in known:
        if version < before:
            manifests.withdraw(spark, path, version)
    named = set()
    for version in known:
        if version >= before:
            named.update(r.held_by for r in _parts_of(spark, path, version).select("held_by").distinct().collect())
    gone = [int(n.removeprefix("version=")) for n in manifests.names(spark, f"{path}/data") if n.startswith("version=")]
    gone = sorted(v for v in gone if v not in named and v < before)
    for version in gone:
        manifests.remove(spark, f"{path}/data/version={version}")
    return gone
