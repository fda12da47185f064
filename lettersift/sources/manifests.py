"""Commits of versioned folders: a small manifest per version, written last and read by name.

Data of a version that has no manifest does not exist for readers, so a half-written version is invisible. A manifest
lists what to read, so that reading opens what is listed and never looks through the versions before.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_FOLDER = "_manifests"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    place, files = _path(spark, path)
    try:
        return [s.getPath().getName() for s in files.listStatus(place)]
    except Py4JJavaError as error:
        if "FileNotFoundException" not in str(error.java_exception):
            raise
        return []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions with a manifest, in order."""
    found = (re.fullmatch(r"version=(\d+)", n) for n in names(spark, f"{path}/{_FOLDER}"))
    return sorted(int(m[1]) for m in found if m)


def commit(rows: DataFrame, path: str, version: int) -> None:
    """Make a version visible: ``rows`` is its manifest."""
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{_FOLDER}/version={version}")


def withdraw(spark: SparkSession, path: str, version: int) -> None:
    """Hide a version before its data is written again."""
    remove(spark, f"{path}/{_FOLDER}/version={version}")


def manifest(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame | None:
    """The manifest of one version, or None if it was not committed."""
    place = f"{path}/{_FOLDER}/version={version}"
    try:
        rows = spark.read.schema(schema).json(place)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows if "_SUCCESS" in names(spark, place) else None
