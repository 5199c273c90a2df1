"""Session settings every job shares, and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Epoch arithmetic on archive timestamps must not depend on the host zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot trace or run may feed an aggregate right after its join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Nanosecond Parquet timestamps arrive as BIGINT.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    # Counts and time ranges of stored tables come from Parquet footers, where a scan can ask them.
    "spark.sql.parquet.aggregatePushdown": "true",
    # Later attributes replace earlier ones when label maps are merged.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Bytes of one task, where the caller names none. Files and shuffles of ids and repeated names are
#: compressed tenfold and more, and a task's hash tables and sorts hold them unpacked.
TASK_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}

#: A second file beside each file of a checkpoint, where the caller names nothing. A join has four stores
#: a partition, each of which waited for these in every batch; the file system's own checksums stay.
CHECKPOINTS = {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in (TASK_SIZES | CHECKPOINTS).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


#: Names the shared folder where the cluster does not; callers on one machine set it.
WORK_SETTING = "faultline.work.dir"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder of the cluster (`spark.checkpoint.dir`)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_SETTING, None)
    if not base:
        raise ValueError(f"set spark.checkpoint.dir or {WORK_SETTING} to a folder all executors can reach")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: What is written leaves no shuffle files, which else stay until the driver collects its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that lie together by some keys of a join are not dealt again by all of them.
DEALT_ONCE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What is planned and run inside has these settings; the caller's come back."""
    kept = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in kept.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Writes an intermediate result once so that several consumers do not recompute it."""
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
