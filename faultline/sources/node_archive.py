"""Node-level archives: Parquet tables with JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators.collapse import without_collisions

# Optional labels of a node metric.
NODE_LABELS = ("domain", "entity_set", "entity_id", "entity_name", "metric_set_id", "service")
# Label names and the source columns they come from.
CONTAINER_LABELS = {
    "container_name": "_container_name_", "pod_name": "_pod_name_", "pod_uid": "_pod_uid_",
    "namespace": "_namespace_", "node_name": "__tag__:_node_name_", "node_ip": "__tag__:_node_ip_",
    "source": "_source_",
}
EVENT_LABELS = {
    "pod_name": "pod_name", "pod_uid": "pod_id", "host_name": "hostname",
    "cluster_id": "clusterId", "cluster_name": "clusterName", "level": "level",
}
ALERT_LABELS = {
    "subject": "subject", "status": "status", "severity": "severity", "source_type": "sourcetype",
}
ALERT_MESSAGE = ("subject", "status", "severity", "resource", "labels", "annotations")


def _labels(rows: DataFrame, fields: dict[str, str]) -> Column:
    return N.drop_empty(
        N.renamed_labels(
            (label, F.col(f"`{source}`")) for label, source in fields.items()
            if source in rows.columns
        )
    )


def read_node_metrics(
    spark: SparkSession, path: str, window: tuple[int, int] | None = None
) -> DataFrame:
    """A10. Node metric samples; null and non-finite values are dropped. Two names that
    fold to one end the job.

    The window is compared on the raw microseconds, so the scan can use it.
    """
    rows = spark.read.parquet(path)
    if window is not None:
        rows = rows.where(W.half_open("time", window[0] * 1_000_000, window[1] * 1_000_000))
    return without_collisions(rows.where(N.is_finite("value")).select(
        N.fold_metric_name(F.coalesce("metric", F.lit(""))).alias("metric"),
        F.col("metric").alias("source_name"),
        W.floor_div("time", 1000).alias("ts_ms"),
        F.col("value").cast("double").alias("value"),
        _labels(rows, {n: n for n in NODE_LABELS}).alias("labels"),
    ))


def read_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """A11."""
    rows = spark.read.parquet(path)
    return rows.select(
        N.iso_to_nanoseconds("_time_").alias("ts_ns"),
        F.coalesce("content", F.lit("")).alias("message"),
        _labels(rows, CONTAINER_LABELS).alias("labels"),
        F.lit("logs").alias("log_table"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A12. Cluster events; the first of three times counts, an event without any ends the job."""
    payload = F.coalesce(F.nullif("eventId", F.lit("")), F.lit("{}"))
    times = F.from_json(
        "_payload",
        "lastTimestamp string, eventTime string, metadata struct<creationTimestamp:string>",
    )
    empty = F.lit("")
    at = F.coalesce(
        F.nullif("_times.lastTimestamp", empty),
        F.nullif("_times.eventTime", empty),
        F.nullif("_times.metadata.creationTimestamp", empty),
    )
    # Columns of their own, so that a payload is parsed once and not at every use of its time.
    rows = spark.read.parquet(path).withColumn("_payload", payload)
    rows = rows.withColumn("_times", times).withColumn("_at", at)
    missing = F.raise_error(F.lit("event has no timestamp")).cast("bigint")
    return rows.select(
        F.coalesce(N.iso_to_nanoseconds("_at"), missing).alias("ts_ns"),
        F.col("_payload").alias("message"),
        _labels(rows, EVENT_LABELS).alias("labels"),
        F.lit("events").alias("log_table"),
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """A13. Alerts; six columns form the message."""
    rows = spark.read.parquet(path)
    message = F.to_json(F.struct(*ALERT_MESSAGE), {"ignoreNullFields": "false"})
    return rows.select(
        N.to_nanoseconds("time_s").alias("ts_ns"),
        message.alias("message"),
        _labels(rows, ALERT_LABELS).alias("labels"),
        F.lit("alerts").alias("log_table"),
    )


def _json_map(rows: DataFrame, name: str) -> Column:
    text = F.nullif(F.col(name), F.lit(""))
    parsed = F.from_json(text, "map<string,string>")
    problem = F.raise_error(F.lit(f"{name} must be a JSON object")).cast("map<string,string>")
    empty = F.expr("cast(map() AS map<string,string>)")
    return F.when(text.isNull(), empty).otherwise(F.coalesce(parsed, problem))


EVENTS = "array<map<string,string>>"


def read_json_spans(spark: SparkSession, path: str) -> DataFrame:
    """A14. Spans with JSON resources, attributes and events; unknown kinds and documents that are
    not what their column holds end the job."""
    rows = spark.read.parquet(path)
    kind = F.coalesce(F.col("kind").cast("int"), F.lit(0))
    bad_kind = F.raise_error(F.concat(F.lit("invalid span kind: "), kind.cast("string")))
    listed = F.nullif("events", F.lit(""))
    events = F.when(listed.isNull(), F.array().cast(EVENTS)).otherwise(
        F.coalesce(
            F.when(F.ltrim(listed).startswith("["), F.from_json(listed, EVENTS)),
            F.raise_error(F.lit("span events must be a list of JSON objects")).cast(EVENTS),
        )
    )
    start = F.coalesce(F.col("startTime").cast("bigint"), F.lit(0))
    end = F.coalesce(F.col("endTime").cast("bigint"), F.lit(0))

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    return rows.select(
        text("traceId", "").alias("trace_id"),
        text("spanId", "").alias("span_id"),
        text("parentSpanId", "").alias("parent_span_id"),
        text("spanName", "unknown").alias("span_name"),
        F.when(kind.between(0, 5), N.span_kind_name(kind))
        .otherwise(bad_kind.cast("string"))
        .alias("span_kind"),
        N.status_name(F.coalesce(F.col("statusCode").cast("int"), F.lit(0))).alias("status_code"),
        text("statusMessage", "").alias("status_message"),
        start.alias("ts_ns"),
        F.greatest(end, start).alias("end_ns"),
        text("serviceName", "unknown").alias("service_name"),
        _json_map(rows, "resources").alias("resource"),
        _json_map(rows, "attributes").alias("attributes"),
        events.alias("events"),
    )
