"""Telemetry operators on Structured Streaming (K1-K6).

Inputs are streams with an event time `ts` (TIMESTAMP). All state is bounded by
a watermark, or by the number of observed identities where that is said.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from faultline.operators.callgraph import CLIENT, ERROR, SERVER
from faultline.session import SHUFFLES_GO, settings


def run_available(
    stream: DataFrame, path: str, mode: str = "append", given: dict[str, str] | None = None
) -> DataFrame:
    """Runs a stream over all input that is there, with the `given` settings, and returns what it wrote.

    Results go to files with an exactly-once commit log, never through the driver.
    """
    spark = stream.sparkSession
    with settings(spark, given or {}):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{path}/rows")
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


#: Rows of a batch for each partition of state, some 500 bytes each in the memory of an executor.
STATE_ROWS = 100_000
#: Rows of a file of a stream in order of time, which is what one task reads.
FILE_ROWS = 200_000


def state_partitions(spark: SparkSession) -> int:
    """Partitions of state for batches of bounded size: no more than the caller's, and a few a core.
    Every batch commits all of them, so they follow the cluster and not the length of the stream."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def in_batches(spark: SparkSession) -> dict[str, str]:
    """Settings of a stream of many bounded batches, whose old state does not stay on disk: a store is
    written whole after a few batches, and what came before goes soon, from memory at once."""
    return {
        "spark.sql.shuffle.partitions": str(state_partitions(spark)),
        "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.sql.streaming.maxBatchesToRetainInMemory": "1",
        "spark.sql.streaming.stateStore.minDeltasForSnapshot": "3",
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    }


def stream_by_time(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows as files that follow each other in `ts`, and opens them as a stream in this order.

    A batch takes as many rows as its state has room for, and no row is late, so a watermark drops old
    state between batches. Where files can't be put in order, one batch takes all.
    """
    spark = rows.sparkSession
    count = rows.count()
    with settings(spark, SHUFFLES_GO):
        rows.repartitionByRange(max(1, math.ceil(count / FILE_ROWS)), "ts").write.option(
            "compression", "zstd").parquet(path)
    reader = spark.readStream.schema(rows.schema)
    if files := put_in_order(spark, path):
        batch = STATE_ROWS * state_partitions(spark)
        reader = reader.option("maxFilesPerTrigger", max(1, files * batch // max(1, count)))
    return reader.parquet(path)


def put_in_order(spark: SparkSession, path: str) -> int:
    """Gives the files of a folder times in order of their names, a second apart; how many there are.

    A file stream takes files by time. Where a store keeps its own times, none are in order.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def listed() -> list:
        return sorted((f for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")),
                      key=lambda f: f.getPath().getName())

    before = listed()
    first = min((f.getModificationTime() for f in before), default=0) // 1000 - len(before)
    for at, file in enumerate(before):
        store.setTimes(file.getPath(), (first + at) * 1000, -1)
    times = [f.getModificationTime() for f in listed()]
    return len(times) if all(a < b for a, b in zip(times, times[1:])) else 0


def _sides(spans: DataFrame, delay: str) -> tuple[DataFrame, DataFrame]:
    clients = (
        spans.where((F.col("span_kind") == CLIENT) & (F.col("span_id") != ""))
        .select(
            F.col("trace_id").alias("c_trace"), F.col("span_id").alias("c_span"),
            F.col("service_name").alias("src_id"), F.col("ts").alias("c_ts"),
        )
        .withWatermark("c_ts", delay)
    )
    servers = (
        spans.where((F.col("span_kind") == SERVER) & (F.col("parent_span_id") != ""))
        .select(
            F.col("trace_id").alias("s_trace"), F.col("parent_span_id").alias("s_parent"),
            F.col("service_name").alias("dst_id"), F.col("ts").alias("s_ts"),
            (F.col("status_code") == ERROR).alias("error"),
            F.col("duration_ns").alias("duration_ns"),
        )
        .withWatermark("s_ts", delay)
    )
    return clients, servers


def _child() -> Column:
    return (
        (F.col("c_trace") == F.col("s_trace"))
        & (F.col("c_span") == F.col("s_parent"))
        & (F.col("s_ts") >= F.col("c_ts") - F.expr("INTERVAL 5 MINUTES"))
        & (F.col("s_ts") <= F.col("c_ts") + F.expr("INTERVAL 1 HOUR"))
    )


def stream_call_edges(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K1. Call edges in 60-second bins of the client time, emitted when a bin is final.

    The time bounds of the pairing let Spark drop join state once neither side
    can match any more.
    """
    clients, servers = _sides(spans, delay)
    pairs = clients.join(servers, _child()).where(F.col("src_id") != F.col("dst_id"))
    bins = pairs.groupBy(F.window("c_ts", "60 seconds"), "src_id", "dst_id").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if("error").alias("error_count"),
        F.sum(F.col("duration_ns").cast("decimal(38,0)")).alias("duration_sum"),
        F.max("duration_ns").alias("duration_max"),
    )
    return bins.select(
        F.unix_seconds("window.start").alias("window_start"), "src_id", "dst_id",
        "request_count", "error_count", F.col("duration_sum").cast("double").alias("duration_sum"),
        "duration_max",
    )


def stream_unmatched_clients(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K2. Clients without a server child, emitted once no child can arrive any more."""
    clients, servers = _sides(spans, delay)
    joined = clients.join(servers, _child(), "left_outer")
    return joined.where(F.col("s_trace").isNull()).select(
        F.col("c_trace").alias("trace_id"), F.col("c_span").alias("span_id"),
        F.col("src_id").alias("service_name"), F.col("c_ts").alias("ts"),
    )


def stream_distinct_samples(
    samples: DataFrame, keys: list[str], delay: str = "10 minutes"
) -> DataFrame:
    """K3. The first sample per key within the watermark.

    Streams keep the first of a repetition; the last observation wins only in the
    batch collapse, which knows the whole source.
    """
    return samples.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class TransitionReporter(StatefulProcessor):
    """K4. Counters of one identity and whether it was reported; all of it goes when its case ends."""

    def __init__(self, keys: list[str], case_end: int):
        self.keys, self.case_end = keys, case_end

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "normal long, normal_high long, abnormal long, abnormal_high long, reported boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        if timerValues.getCurrentWatermarkInMs() >= self.case_end * 1000:
            return  # the case is over and forgotten
        known = self.facts.get() if self.facts.exists() else (0, 0, 0, 0, False)
        counts, reported = list(known[:4]), known[4]
        if not self.facts.exists():
            self.handle.registerTimer(self.case_end * 1000)
        for frame in rows:
            normal, high = frame["normal"], frame["high"]
            for at, flags in enumerate((normal, normal & high, ~normal, ~normal & high)):
                counts[at] += int(flags.sum())
        normal, normal_high, abnormal, abnormal_high = counts
        proven = normal >= 1 and abnormal >= MINIMUM and normal_high == 0 and abnormal_high >= MINIMUM
        self.facts.update((*counts, reported or proven))
        if proven and not reported:
            yield pd.DataFrame([dict(zip(self.keys, key))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.facts.clear()
        return iter([])


#: Anomalous observations that prove a transition.
MINIMUM = 2
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect_transitions(
    samples: DataFrame, keys: list[str], boundary: int, threshold: float, path: str,
    case: tuple[int, int], delay: str = "10 minutes",
) -> DataFrame:
    """K4. Identities of a case whose transition is proven, each reported once.

    State is one row per identity with a flag for what was reported, and a timer drops it at the end of
    the case, so a batch costs what its rows cost, however many identities were reported before. The
    file sink keeps a commit log: a batch that runs again replaces its own files.
    """
    spark = samples.sparkSession
    kept = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKS)
    seconds = F.unix_seconds("ts")
    # The time itself stays behind, so that rows count until the watermark has passed the whole case.
    inside = samples.withWatermark("ts", delay).where(seconds.between(case[0], case[1] - 1)).select(
        *keys, (seconds < boundary).alias("normal"),
        F.coalesce(F.col("value") >= F.lit(threshold), F.lit(False)).alias("high"),
    )
    schema = samples.select(*keys).schema
    found = inside.groupBy(*keys).transformWithStateInPandas(
        TransitionReporter(keys, case[1]), schema, "Append", "EventTime")
    try:
        query = (
            found.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{path}/checkpoint")
            .option("path", f"{path}/reported")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, kept)
    return spark.read.schema(schema).parquet(f"{path}/reported")


# The sliding input budget of a provider.
TOKEN_BUDGET = 1_800_000


def stream_token_use(
    calls: DataFrame, provider: str, tokens: str, delay: str = "1 minute",
    width: str = "60 seconds", slide: str = "10 seconds", budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """K5. Tokens per provider in sliding windows, with a flag above the budget."""
    used = (
        calls.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide), provider)
        .agg(F.sum(tokens).alias("tokens"))
    )
    return used.select(
        F.unix_seconds("window.start").alias("window_start"), provider, "tokens",
        (F.col("tokens") > F.lit(budget)).alias("over_budget"),
    )


def stream_period_counts(rows: DataFrame, keys: list[str], width: str, delay: str) -> DataFrame:
    """K6. Rows per half-open window; a row exactly at an end belongs to the next window."""
    counted = rows.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return counted.select(F.unix_seconds("window.start").alias("window_start"), *keys, "rows")


def count_late_rows(rows: DataFrame, delay_seconds: int, path: str) -> DataFrame:
    """K6. Rows per batch that come later than the delay allows; they are counted, not folded.

    Each batch leaves one ledger row with its newest event time. A batch compares
    against the newest time of the batches before it, as the watermark does.
    """
    ledger = f"{path}/ledger"
    schema = "rows long, late_rows long, newest long, batch long"
    spark = rows.sparkSession

    def account(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        at = F.unix_micros("ts")
        counted = batch.select(at.alias("at"))
        if batch_id > 0:
            before = session.read.schema(schema).parquet(ledger)
            limit = before.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            late = F.lit(False) if limit is None else (
                F.col("at") < F.lit(limit - delay_seconds * 1_000_000)
            )
        else:
            late = F.lit(False)
        counted.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(late).alias("late_rows"),
            F.max("at").alias("newest"),
        ).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    query = (
        rows.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(account)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(ledger)
