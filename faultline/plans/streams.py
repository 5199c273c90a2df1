"""Streaming queries, replayed over streams that Spark writes from the given tables.

A replay ends with one closing row far behind the last event, so that every
window of the real data becomes final and the result equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.plans.registry import query
from faultline.plans.views import EVENTS_BOUNDARY, EVENTS_END, EVENTS_START, SECOND, WINDOW
from faultline.session import work_dir
from faultline.streaming import telemetry as S

SPANS = "clients_src servers_src spans"
MICROS = 1_000_000


def replay(t, rows, files_per_batch=None):
    """Writes rows as a stream folder and opens it as a stream."""
    path = work_dir(t.spark, "stream")
    rows.write.parquet(path)
    reader = t.spark.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def closing(rows, **overrides):
    """One row ten days behind the newest event, with the given values."""
    newest = rows.agg(F.max("ts").alias("newest"))
    end = F.col("newest") + F.expr("INTERVAL 10 DAYS")
    return newest.select(
        *[
            (end if f.name == "ts" else F.lit(overrides.get(f.name)).cast(f.dataType)).alias(f.name)
            for f in rows.schema.fields
        ]
    )


def span_stream(t):
    rows = t.spans.select(
        F.timestamp_micros(W.floor_div("ts_ns", 1000)).alias("ts"),
        "trace_id", "span_id", "parent_span_id", "service_name", "span_kind", "status_code",
        (F.col("end_ns") - F.col("ts_ns")).alias("duration_ns"),
    )
    ends = [
        closing(rows, span_kind=kind, trace_id="end", span_id="end", parent_span_id="none",
                service_name="end")
        for kind in ("SPAN_KIND_CLIENT", "SPAN_KIND_SERVER")
    ]
    return S.stream_by_time(rows.unionByName(ends[0]).unionByName(ends[1]), work_dir(t.spark, "stream"))


STREAM_PAIRS = """sp AS (SELECT c.ts_ns AS client_ns, c.service_name AS src_id, s.service_name AS dst_id,
    s.status_code = 'STATUS_CODE_ERROR' AS error, s.end_ns - s.ts_ns AS d
  FROM spans c JOIN spans s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
   AND s.ts_ns >= c.ts_ns - 300 * 1000000000::BIGINT AND s.ts_ns <= c.ts_ns + 3600 * 1000000000::BIGINT
  WHERE c.span_kind = 'SPAN_KIND_CLIENT' AND s.span_kind = 'SPAN_KIND_SERVER')"""


@query(
    "k1_stream_call_edges",
    SPANS,
    f""", {STREAM_PAIRS} SELECT (client_ns // 60000000000) * 60 AS window_start, src_id, dst_id,
          count(*) AS request_count, count(CASE WHEN error THEN 1 END) AS error_count,
          sum(d)::DOUBLE AS duration_sum, max(d) AS duration_max
        FROM sp WHERE src_id <> dst_id GROUP BY ALL""",
)
def call_edges(t):
    stream = S.stream_call_edges(span_stream(t))
    return S.run_available(stream, work_dir(t.spark, "k1"), given=S.in_batches(t.spark))


@query(
    "k2_stream_unmatched_clients",
    SPANS,
    """SELECT trace_id, span_id, service_name FROM spans c WHERE span_kind = 'SPAN_KIND_CLIENT'
       AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.trace_id = c.trace_id
         AND s.parent_span_id = c.span_id AND s.span_kind = 'SPAN_KIND_SERVER'
         AND s.ts_ns >= c.ts_ns - 300 * 1000000000::BIGINT
         AND s.ts_ns <= c.ts_ns + 3600 * 1000000000::BIGINT)""",
)
def unmatched(t):
    stream = S.stream_unmatched_clients(span_stream(t))
    return S.run_available(stream, work_dir(t.spark, "k2"), given=S.in_batches(t.spark)).drop("ts")


def sample_rows(t):
    return t.points.select(
        F.timestamp_micros(W.floor_div("ts_ns", 1000)).alias("ts"),
        "metric", "container", "value", "k",
        (W.floor_div("ts_s", 3600) * 3_600_000).alias("ts_ms"),
    )


@query(
    "k3_stream_distinct_samples",
    "points samples",
    "SELECT DISTINCT metric, container, ts_ms FROM samples",
)
def distinct_samples(t):
    stream = replay(t, sample_rows(t))
    kept = S.stream_distinct_samples(stream, ["metric", "container", "ts_ms"], "2 hours")
    return S.run_available(
        kept.select("metric", "container", "ts_ms"), work_dir(t.spark, "k3")
    )


@query(
    "k4_stream_transitions",
    "points",
    """SELECT metric, container FROM points GROUP BY metric, container
       HAVING count(CASE WHEN ts_s < 1705276800 THEN 1 END) >= 1
         AND count(CASE WHEN ts_s < 1705276800 AND value >= 200 THEN 1 END) = 0
         AND count(CASE WHEN ts_s >= 1705276800 THEN 1 END) >= 2
         AND count(CASE WHEN ts_s >= 1705276800 AND value >= 200 THEN 1 END) >= 2""",
)
def transitions(t):
    return S.detect_transitions(
        replay(t, sample_rows(t)), ["metric", "container"], EVENTS_BOUNDARY, 200.0,
        work_dir(t.spark, "k4"), (EVENTS_START, EVENTS_END),
    )


@query(
    "k5_stream_token_use",
    "points",
    """, w AS (SELECT (ts_s // 10 - i) * 10 AS window_start, service_name AS provider, src_order AS tokens
              FROM points, range(0, 6) r(i))
       SELECT window_start, provider, sum(tokens)::BIGINT AS tokens, sum(tokens) > 5000 AS over_budget
       FROM w GROUP BY window_start, provider""",
)
def token_use(t):
    rows = t.points.select(
        F.timestamp_micros(W.floor_div("ts_ns", 1000)).alias("ts"),
        F.col("service_name").alias("provider"), F.col("src_order").alias("tokens"),
    )
    stream = replay(t, rows.unionByName(closing(rows, provider="end", tokens=0)))
    used = S.stream_token_use(stream, "provider", "tokens", budget=5000)
    return S.run_available(used, work_dir(t.spark, "k5"))


@query(
    "k6_stream_period_counts",
    "points",
    """SELECT (ts_s // 3600) * 3600 AS window_start, metric, count(*) AS rows FROM points
       GROUP BY window_start, metric""",
)
def period_counts(t):
    rows = sample_rows(t).select("ts", "metric")
    stream = replay(t, rows.unionByName(closing(rows, metric="end")))
    counted = S.stream_period_counts(stream, ["metric"], "1 hour", "10 minutes")
    return S.run_available(counted, work_dir(t.spark, "k6"))


@query(
    "k6_late_rows",
    "points",
    f"""SELECT count(*) AS rows,
          count(CASE WHEN ts_s < {EVENTS_BOUNDARY} AND ts_s < (SELECT max(ts_s) FROM points) - 600 THEN 1 END)
            AS late_rows FROM points""",
)
def late_rows(t):
    """The newer half arrives first; the older half comes in later batches, all of it late."""
    rows = sample_rows(t).select("ts", "metric")
    old = F.unix_seconds("ts") < EVENTS_BOUNDARY
    path = work_dir(t.spark, "stream")
    rows.where(~old).write.parquet(path)
    first = len(t.spark.read.schema(rows.schema).parquet(path).inputFiles())
    rows.where(old).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", first).parquet(path)
    ledger = S.count_late_rows(stream, 600, work_dir(t.spark, "late"))
    return ledger.agg(F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))
