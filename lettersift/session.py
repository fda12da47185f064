"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


# Generated methods above 8000 bytes are not compiled by the JVM; wide rule expressions then run
# faster as separate projections.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Limits per group up to this size are applied in every task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Plans with many rule terms are long; keep their descriptions from filling the driver.
    "spark.sql.maxPlanStringLength": "300000",
    # Raw mails can hold large attachments, and what is found in a text can be longer than the text: keep the batches
    # sent to Python and back small, in a session that the caller built, too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Settings of a given session that results and speed depend on."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested with.

    Partition counts are left to adaptive execution unless given: it starts from
    ``shuffle_partitions`` and merges small ones.
    """
    builder = (
        SparkSession.builder.appName("lettersift")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Without call sites expressions are built about twice as fast.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a session in one local process may go without that setting; it gets a folder of its own, once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="lettersift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lettersift/{purpose}-{uuid.uuid4().hex}"
