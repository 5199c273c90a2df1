"""Canonical tables and report artifacts."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.operators.audit import (
    BUCKET,
    RECORD_BUCKETS,
    bucket_digests,
    changed_buckets,
    dataset_digest,
    record_bucket,
)
from faultline.operators.callgraph import LINK, link_id
from faultline.session import work_dir

_V1_SOURCES = "spark.sql.sources.useV1SourceList"

#: What stored spans are clustered by. A call's two sides share both; a huge trace has many links.
SPAN_CLUSTER = ("trace_id", LINK)


def write_telemetry(rows: DataFrame, path: str, signal: str, ts_ns: str = "ts_ns") -> None:
    """A23. Appends one signal to the canonical tables, partitioned by signal and date.

    One metrics table with a metric column replaces a table per metric. The
    rebalance lets the adaptive planner split a busy day over several writers
    and merge quiet ones, so files have an even size.
    """
    day = F.to_date(F.timestamp_seconds(W.floor_div(ts_ns, 1_000_000_000)))
    # Time comes first: statistics of nested columns would shift its place in the footers.
    ordered = rows.select(ts_ns, *[c for c in rows.columns if c != ts_ns])
    placed = ordered.withColumn("signal", F.lit(signal)).withColumn("date", day)
    (
        placed.hint("rebalance", "date")
        .write.mode("append")
        .partitionBy("signal", "date")
        .parquet(path)
    )


def read_telemetry(spark, path: str, signal: str, schema: str | None = None) -> DataFrame:
    """A23. One signal of the canonical tables; other signals are pruned by folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("basePath", path).parquet(f"{path}/signal={signal}")


def stored_stats(spark, path: str, ts_ns: str = "ts_ns") -> DataFrame:
    """F13/I13. Rows and time range of every signal of the canonical tables, from file footers alone.

    The folder is read as a source that takes aggregates, grouped by its folders; no column is read.
    `write_telemetry` puts the time first in every file, which is where this looks for it.
    """
    kept = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(s for s in kept.split(",") if s != "parquet"))
    try:
        stored = spark.read.schema(f"{ts_ns} BIGINT, signal STRING, date DATE").parquet(path)
    finally:
        spark.conf.set(_V1_SOURCES, kept)
    by_folder = stored.groupBy("signal", "date").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts_ns).alias("low"), F.max(ts_ns).alias("high")
    )
    return by_folder.groupBy("signal").agg(
        F.sum("n").alias("row_count"), F.min("low").alias("min_time"), F.max("high").alias("max_time")
    )


#: A bucket is one task of writing and of pairing, which sorts it: some 270 bytes a span.
SPANS_PER_BUCKET = 500_000


def span_buckets(spans: DataFrame) -> int:
    """Buckets that keep their size however many spans there are; 8 at least."""
    return max(8, math.ceil(spans.count() / SPANS_PER_BUCKET))


def write_spans(spans: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A23. Spans as a table at `path` in which both sides of every call lie in one bucket.

    Pairing (E1 to E6, F1, F2) then joins and groups without a shuffle. Rows are dealt as buckets
    are, so that a bucket is one sorted file per date. `span_buckets` gives a number that grows with
    the spans.
    """
    day = F.to_date(F.timestamp_seconds(W.floor_div("ts_ns", 1_000_000_000)))
    (
        spans.withColumn(LINK, link_id())
        .withColumn("date", day)
        .repartition(buckets, *SPAN_CLUSTER)
        .write.mode("overwrite")
        .partitionBy("date")
        .bucketBy(buckets, *SPAN_CLUSTER)
        .sortBy(*SPAN_CLUSTER)
        .option("path", path)
        .saveAsTable(table)
    )
    return spans.sparkSession.table(table)


def open_spans(spark, table: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A23. Names a folder of `write_spans` in another session's catalog.

    `schema` lists the span columns as DDL, without link and date; `buckets` must be those it was
    written with.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}, {LINK} STRING, date DATE) USING parquet "
        f"PARTITIONED BY (date) CLUSTERED BY ({', '.join(SPAN_CLUSTER)}) "
        f"SORTED BY ({', '.join(SPAN_CLUSTER)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def write_runs(rows: DataFrame) -> DataFrame:
    """A18. Rows as a table in which all of a run lies in one bucket, of which there are as many as a
    shuffle has partitions. Facts of runs are then grouped and joined by run id without a shuffle."""
    spark = rows.sparkSession
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"runs_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, "run_id")
        .write.bucketBy(buckets, "run_id")
        .option("compression", "zstd")
        .option("path", work_dir(spark, "runs"))
        .saveAsTable(table)
    )
    return spark.table(table)


def write_records(rows: DataFrame, path: str, keys: list[str], buckets: int = RECORD_BUCKETS) -> DataFrame:
    """A23 for audited copies: records by hash bucket, with a table of the buckets' digests beside.

    `changed_records` compares two such copies by their digests and opens only buckets that differ.
    """
    placed = rows.withColumn(BUCKET, record_bucket(keys, buckets))
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/records")
    records = read_records(rows.sparkSession, path)
    bucket_digests(records, keys, buckets).write.mode("overwrite").parquet(f"{path}/digests")
    return records


def read_records(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")


def changed_records(spark, left: str, right: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records of two copies by `write_records` in buckets whose digests differ; no other is read."""
    digests = [spark.read.parquet(f"{p}/digests") for p in (left, right)]
    changed = changed_buckets(*digests)
    return tuple(read_records(spark, p).where(F.col(BUCKET).isin(changed)).select(*keys) for p in (left, right))


def write_report(table: DataFrame, path: str, order: list[str]) -> DataFrame:
    """A24. A report table as sorted JSON lines, with its digest (I8).

    Returns the digest row, which is written beside the table.
    """
    lines = table.select(*sorted(table.columns)).orderBy(*order)
    lines.write.mode("overwrite").json(f"{path}/table")
    digest = dataset_digest(table, [F.col(c) for c in sorted(table.columns)])
    digest.write.mode("overwrite").json(f"{path}/digest")
    return table.sparkSession.read.schema(digest.schema).json(f"{path}/digest")
