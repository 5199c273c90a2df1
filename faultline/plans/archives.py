"""Readers and sinks, over archives that Spark derives from the given tables.

Every query writes an archive in the layout of its reader below the shared work
folder, reads it back and is compared with SQL over the tables it came from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators import collapse as C
from faultline.plans.registry import query
from faultline.plans.views import EVENTS_BOUNDARY, SECOND
from faultline.session import work_dir
from faultline.sources import case_files, csv_archive, node_archive, responses, sinks, wide_archive


class Archive:
    """A fresh folder for the files of one query."""

    def __init__(self, t):
        self.spark = t.spark
        self.root = work_dir(t.spark, "archive")

    def parquet(self, name, df):
        df.write.parquet(f"{self.root}/{name}")
        return f"{self.root}/{name}"

    def csv(self, name, df):
        df.write.option("header", "true").option("escape", '"').csv(f"{self.root}/{name}")
        return f"{self.root}/{name}"

    def json(self, name, df):
        df.write.json(f"{self.root}/{name}")
        return f"{self.root}/{name}"


def by_period(archive, name, rows):
    """Splits rows into a normal and an abnormal file set, as the archives do."""
    normal = F.col("time") < EVENTS_BOUNDARY * SECOND
    return [
        archive.parquet(f"normal_{name}.parquet", rows.where(normal)),
        archive.parquet(f"abnormal_{name}.parquet", rows.where(~normal)),
    ]


POINT_ATTRIBUTES = ["k8s.container.name", "k8s.pod.name"]


def gauge_rows(points):
    return points.select(
        F.col("ts_ns").alias("time"), "metric", "value",
        F.when(F.col("k") % 6 > 0, F.col("service_name")).alias("service_name"),
        F.col("container").alias("attr.k8s.container.name"),
        F.when(F.col("k") % 2 == 0, F.col("pod")).otherwise("").alias("attr.k8s.pod.name"),
    )


PERIOD = "CASE WHEN ts_s < 1705276800 THEN 'normal' ELSE 'abnormal' END"


@query(
    "a1_read_numbers",
    "points",
    f"""SELECT metric, ts_ns, value, CASE WHEN k % 6 > 0 THEN service_name END AS service_name,
          container, CASE WHEN k % 2 = 0 THEN pod END AS pod, {PERIOD} AS period FROM points""",
)
def numbers(t):
    paths = by_period(Archive(t), "metrics", gauge_rows(t.points))
    rows = wide_archive.read_numbers(t.spark, paths, attributes=POINT_ATTRIBUTES)
    return rows.select(
        "metric", "ts_ns", "value", "service_name",
        F.col("attributes")["k8s.container.name"].alias("container"),
        F.col("attributes")["k8s.pod.name"].alias("pod"), "period",
    )


def histogram_rows(t):
    return t.points.select(
        F.col("ts_ns").alias("time"), F.concat("metric", F.lit(".size")).alias("metric"),
        "service_name", F.col("k").cast("double").alias("count"),
        F.when(F.col("k") % 4 > 0, F.col("value")).alias("sum"),
        F.lit(0.5).alias("min"), F.col("value").alias("max"),
        F.col("container").alias("attr.container"),
    )


@query(
    "a2_read_histograms",
    "points",
    f"""SELECT metric || '.size' AS metric, ts_ns, k AS "count", CASE WHEN k % 4 > 0 THEN value END AS "sum",
          value AS "max", container, {PERIOD} AS period FROM points""",
)
def histograms(t):
    paths = by_period(Archive(t), "metrics_histogram", histogram_rows(t))
    rows = wide_archive.read_histograms(t.spark, paths, ["container"])
    return rows.select(
        "metric", "ts_ns", "count", "sum", "max",
        F.col("attributes")["container"].alias("container"), "period",
    )


@query(
    "a1_projected_series",
    "points",
    """, m AS (SELECT metric, ts_ns // 1000000 AS ts_ms, container, value AS v, src_order FROM points
           WHERE k % 2 = 0 UNION ALL
           SELECT metric || '_size_count', ts_ns // 1000000, container, k::DOUBLE, src_order FROM points
           UNION ALL SELECT metric || '_size_sum', ts_ns // 1000000, container, value, src_order FROM points
             WHERE k % 4 > 0
           UNION ALL SELECT metric || '_size_bucket', ts_ns // 1000000, container, k::DOUBLE, src_order
             FROM points)
       SELECT metric, count(DISTINCT (container, ts_ms)) AS samples, count(*) AS observations
       FROM m GROUP BY metric""",
)
def projected(t):
    """The whole metric projection: gauges and histograms to collapsed samples."""
    archive = Archive(t)
    gauges = gauge_rows(t.points.where(F.col("k") % 2 == 0))
    numbers_ = wide_archive.point_labels(
        wide_archive.read_numbers(t.spark, by_period(archive, "metrics", gauges), attributes=POINT_ATTRIBUTES)
    )
    points = wide_archive.point_labels(
        wide_archive.read_histograms(t.spark, by_period(archive, "histogram", histogram_rows(t)), ["container"])
    )
    order = wide_archive.SOURCE_ORDER
    fanned = C.histogram_samples(points.drop("attributes", "service_name", "kind", "period"))
    columns = ["metric", "ts_ns", "value", "labels", *order]
    samples = numbers_.select(*columns).unionByName(fanned.select(*columns))
    # The service differs between the two sources; a series here is a container.
    container = F.coalesce(
        F.col("labels")["k8s_container_name"], F.col("labels")["container"]
    )
    keyed = samples.select(
        N.fold_metric_name("metric").alias("metric"), container.alias("container"),
        W.floor_div("ts_ns", 1_000_000).alias("ts_ms"), "value", *order,
    )
    kept = C.last_observation(keyed, ["metric", "container", "ts_ms"], "value", order)
    return kept.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("observations").alias("observations")
    )


@query(
    "a3_read_logs",
    "",
    """SELECT doc_id::VARCHAR AS doc_id, doc_id * 1000000000 + 1705276000000000000 AS ts_ns, text AS message,
         source AS service_name, CASE WHEN doc_id % 2 = 0 THEN lang END AS level,
         (2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS labels FROM documents""",
)
def wide_logs(t):
    rows = t.table("documents").select(
        (F.col("doc_id") * F.lit(SECOND) + F.lit(1705276000 * SECOND)).alias("time"),
        F.col("source").alias("service_name"), F.col("text").alias("message"),
        F.lit("").alias("trace_id"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("level"),
        F.col("doc_id").cast("string").alias("attr.doc"),
    )
    read = wide_archive.read_logs(t.spark, by_period(Archive(t), "logs", rows), ["doc"])
    return read.select(
        F.col("labels")["doc"].alias("doc_id"), "ts_ns", "message",
        F.col("labels")["service_name"].alias("service_name"),
        F.col("labels")["level"].alias("level"),
        F.size("labels").cast("bigint").alias("labels"),
    )


SPANS = "clients_src servers_src spans"


@query(
    "a4_read_spans",
    SPANS,
    """SELECT service_name, span_kind, status_code, count(*) AS spans, min(ts_ns) AS first_ns,
         max(end_ns) AS last_end, count(peer) AS with_peer FROM spans GROUP BY ALL""",
)
def wide_spans(t):
    kind = F.initcap(F.regexp_replace("span_kind", "SPAN_KIND_", ""))
    status = F.initcap(F.regexp_replace("status_code", "STATUS_CODE_", ""))
    rows = t.spans.select(
        F.col("ts_ns").alias("time"), "trace_id", "span_id", "parent_span_id", "span_name",
        kind.alias("attr.span_kind"), "service_name",
        (F.col("end_ns") - F.col("ts_ns")).cast("decimal(20,0)").alias("duration"),
        status.alias("attr.status_code"), F.col("peer").alias("attr.peer"),
    )
    read = wide_archive.read_spans(t.spark, by_period(Archive(t), "traces", rows), ["peer"])
    return read.groupBy("service_name", "span_kind", "status_code").agg(
        F.count(F.lit(1)).alias("spans"), F.min("ts_ns").alias("first_ns"),
        F.max("end_ns").alias("last_end"),
        F.count(F.col("attributes")["peer"]).alias("with_peer"),
    )


WINDOW = (1704412800, 1705276800)
IN_WINDOW = "ts_s BETWEEN 1704412800 AND 1705276800"


@query(
    "a5_read_bank_metrics",
    "points",
    f"""SELECT metric, ts_ms, label, value FROM (
          SELECT m.n AS metric, ts_s * 1000 AS ts_ms, service_name AS label,
            CASE m.n WHEN 'rr' THEN 100 WHEN 'sr' THEN (k + 1)::DOUBLE WHEN 'cnt' THEN src_order::DOUBLE
              WHEN 'mrt' THEN CASE WHEN k % 5 > 0 THEN value END END AS value, ts_s
          FROM points, (VALUES ('rr'), ('sr'), ('cnt'), ('mrt')) m(n) WHERE metric = 'view'
          UNION ALL SELECT 'kpi_' || metric, ts_s * 1000, container, value, ts_s FROM points
            WHERE metric <> 'view') WHERE {IN_WINDOW} AND value IS NOT NULL""",
)
def bank_metrics(t):
    archive = Archive(t)
    rows = t.points
    app = rows.where(F.col("metric") == "view").select(
        F.col("ts_s").alias("timestamp"), F.lit(100).alias("rr"), (F.col("k") + 1).alias("sr"),
        F.col("src_order").alias("cnt"),
        F.when(F.col("k") % 5 > 0, F.col("value")).otherwise(float("nan")).alias("mrt"),
        F.col("service_name").alias("tc"),
    )
    container = rows.where(F.col("metric") != "view").select(
        F.col("ts_s").alias("timestamp"), F.col("container").alias("cmdb_id"),
        F.concat(F.lit("kpi."), "metric").alias("kpi_name"), "value",
    )
    read = csv_archive.read_bank_metrics(
        t.spark, archive.csv("metric_app.csv", app),
        archive.csv("metric_container.csv", container), WINDOW,
    )
    label = F.coalesce(F.col("labels")["tc"], F.col("labels")["cmdb_id"])
    return read.select("metric", "ts_ms", label.alias("label"), "value")


@query(
    "a6_read_market_metrics",
    "points",
    f"""SELECT metric, count(*) AS samples, min(source) AS source, min(kpi) AS kpi, round(sum(v), 4) AS total
        FROM (SELECT m.n AS metric, 'metric_service' AS source, m.n AS kpi,
            CASE m.n WHEN 'count' THEN src_order::DOUBLE ELSE (k + 1)::DOUBLE END AS v, ts_s
          FROM points, (VALUES ('rr'), ('sr'), ('mrt'), ('count')) m(n) WHERE metric = 'view'
          UNION ALL SELECT metric || '_value', 'metric_node', metric || '.value', value, ts_s FROM points
            WHERE metric = 'click'
          UNION ALL SELECT metric || '_value', 'metric_mesh', metric || '.value', value, ts_s FROM points
            WHERE metric NOT IN ('view', 'click')) WHERE {IN_WINDOW} GROUP BY metric""",
)
def market_metrics(t):
    archive = Archive(t)
    service = t.points.where(F.col("metric") == "view").select(
        F.col("service_name").alias("service"), F.col("ts_s").alias("timestamp"),
        (F.col("k") + 1).alias("rr"), (F.col("k") + 1).alias("sr"), (F.col("k") + 1).alias("mrt"),
        F.col("src_order").alias("count"),
    )

    def kpis(which, *order):
        return t.points.where(which).select(
            F.col("ts_s").alias("timestamp"), F.col("container").alias("cmdb_id"),
            F.concat("metric", F.lit(".value")).alias("kpi_name"), "value",
        ).select(*order)

    # The two files have their columns in another order.
    node = kpis(F.col("metric") == "click", "timestamp", "cmdb_id", "kpi_name", "value")
    mesh = kpis(~F.col("metric").isin("view", "click"), "value", "kpi_name", "timestamp", "cmdb_id")
    read = csv_archive.read_market_metrics(
        t.spark, archive.csv("metric_service.csv", service),
        [archive.csv("metric_node.csv", node), archive.csv("metric_mesh.csv", mesh)],
        WINDOW,
    )
    return read.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(F.col("labels")["metric_source"]).alias("source"),
        F.min(F.col("labels")["kpi_name"]).alias("kpi"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query(
    "a7_read_telecom_metrics",
    "points",
    f"""SELECT metric, count(*) AS samples, count(item) AS with_item, round(sum(v), 4) AS total
        FROM (SELECT m.n AS metric, NULL AS item, (k + 1)::DOUBLE AS v, ts_s
          FROM points, (VALUES ('avg_time'), ('num'), ('succee_num'), ('succee_rate')) m(n)
          WHERE metric = 'view'
          UNION ALL SELECT metric || '_value', src_order::VARCHAR, value, ts_s FROM points
            WHERE metric <> 'view') WHERE {IN_WINDOW} GROUP BY metric""",
)
def telecom_metrics(t):
    archive = Archive(t)
    grade = (F.col("k") + 1)
    app = t.points.where(F.col("metric") == "view").select(
        F.col("service_name").alias("serviceName"), (F.col("ts_s") * 1000).alias("startTime"),
        *[grade.alias(n) for n in csv_archive.TELECOM_APP],
    )
    kpis = t.points.where(F.col("metric") != "view").select(
        F.col("src_order").alias("itemid"), F.concat("metric", F.lit("_value")).alias("name"),
        F.lit("bomc").alias("bomc_id"), (F.col("ts_s") * 1000).alias("timestamp"), "value",
        F.col("container").alias("cmdb_id"),
    )
    read = csv_archive.read_telecom_metrics(
        t.spark, archive.csv("metric_app.csv", app), [archive.csv("metric_node.csv", kpis)], WINDOW
    )
    return read.groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.count(F.col("labels")["itemid"]).alias("with_item"),
        F.round(F.sum("value"), 4).alias("total"),
    )


@query(
    "a8_read_csv_logs",
    "",
    """SELECT (doc_id + 1704412800) * 1000000000 AS ts_ns, text AS message, source AS cmdb_id,
         'log_proxy' AS log_source FROM documents WHERE doc_id >= 100""",
)
def csv_logs(t):
    rows = t.table("documents").select(
        F.col("doc_id").alias("log_id"), (F.col("doc_id") + 1704412800).alias("timestamp"),
        F.col("source").alias("cmdb_id"), F.col("lang").alias("log_name"), F.col("text").alias("value"),
    )
    path = Archive(t).csv("log_proxy.csv", rows)
    read = csv_archive.read_csv_logs(t.spark, path, (1704412900, 10**12), with_source=True, multiline=True)
    return read.select(
        "ts_ns", "message", F.col("labels")["cmdb_id"].alias("cmdb_id"),
        F.col("labels")["log_source"].alias("log_source"),
    )


@query(
    "a9_read_csv_spans",
    SPANS,
    """SELECT span_id, CASE WHEN span_kind = 'SPAN_KIND_CLIENT' THEN '' ELSE parent_span_id END
         AS parent_span_id, CASE WHEN span_name LIKE 'op%' THEN span_name ELSE 'RPC' END AS span_name,
         (ts_ns // 1000000) * 1000000 AS ts_ns, service_name AS source_service FROM spans""",
)
def csv_spans(t):
    client = F.col("span_kind") == "SPAN_KIND_CLIENT"
    rows = t.spans.select(
        F.lit("RPC").alias("callType"),
        W.floor_div("ts_ns", 1_000_000).alias("startTime"),
        F.lit("1.5").alias("elapsedTime"), F.lit("True").alias("success"),
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"),
        F.when(client, "None").otherwise(F.col("parent_span_id")).alias("pid"),
        F.col("service_name").alias("cmdb_id"), F.lit("").alias("dsName"),
        F.when(~client, F.col("span_name")).otherwise("").alias("serviceName"),
    )
    read = csv_archive.read_csv_spans(t.spark, Archive(t).csv("trace_span.csv", rows), "telecom")
    return read.select(
        "span_id", "parent_span_id", "span_name", "ts_ns",
        F.col("attributes")["source.cmdb_id"].alias("source_service"),
    )


@query(
    "a10_read_node_metrics",
    "points",
    f"""SELECT metric, ts_ns // 1000000 AS ts_ms, value, container AS entity_id, 'k8s' AS domain,
          2::BIGINT AS labels FROM points WHERE ts_s >= 1704412800 AND ts_s < 1705276800 AND k % 9 > 0""",
)
def node_metrics(t):
    rows = t.points.select(
        W.floor_div("ts_ns", 1000).alias("time"), "metric",
        F.when(F.col("k") % 18 == 0, F.lit(None)).when(F.col("k") % 9 == 0, float("inf"))
        .otherwise(F.col("value")).alias("value"),
        F.lit("k8s").alias("domain"), F.lit("").alias("entity_set"),
        F.col("container").alias("entity_id"), F.lit(None).cast("string").alias("entity_name"),
    )
    path = Archive(t).parquet("metrics.parquet", rows)
    read = node_archive.read_node_metrics(t.spark, path, WINDOW)
    return read.select(
        "metric", "ts_ms", "value", F.col("labels")["entity_id"].alias("entity_id"),
        F.col("labels")["domain"].alias("domain"), F.size("labels").cast("bigint").alias("labels"),
    )


def iso(second, zone="Z", nanos=None):
    text = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")
    parts = [text] + ([F.lit("."), nanos] if nanos is not None else [])
    return F.concat(*parts, F.lit(zone))


@query(
    "a11_read_container_logs",
    "",
    """SELECT doc_id * 60 * 1000000000 + doc_id AS ts_ns, text AS message, source AS pod_name,
         CASE WHEN doc_id % 2 = 0 THEN lang END AS node_name FROM documents""",
)
def container_logs(t):
    doc = F.col("doc_id")
    rows = t.table("documents").select(
        iso(doc * 60, "+00:00", F.lpad(doc.cast("string"), 9, "0")).alias("_time_"),
        F.col("text").alias("content"), F.col("source").alias("_pod_name_"),
        F.when(doc % 2 == 0, F.col("lang")).otherwise("").alias("__tag__:_node_name_"),
    )
    read = node_archive.read_container_logs(t.spark, Archive(t).parquet("logs.parquet", rows))
    return read.select(
        "ts_ns", "message", F.col("labels")["pod_name"].alias("pod_name"),
        F.col("labels")["node_name"].alias("node_name"),
    )


@query(
    "a12_read_events",
    "points",
    """SELECT src_order::VARCHAR AS uid, ts_s * 1000000000 AS ts_ns, container AS pod_name, 'events' AS log_table
       FROM points""",
)
def k8s_events(t):
    at = iso(F.col("ts_s"))
    k = F.col("k") % 3
    payload = F.to_json(
        F.struct(
            F.col("src_order").cast("string").alias("uid"),
            F.when(k == 0, at).alias("lastTimestamp"),
            F.when(k == 1, at).otherwise("").alias("eventTime"),
            F.struct(at.alias("creationTimestamp")).alias("metadata"),
        )
    )
    rows = t.points.select(payload.alias("eventId"), F.col("container").alias("pod_name"))
    read = node_archive.read_events(t.spark, Archive(t).parquet("events.parquet", rows))
    return read.select(
        F.get_json_object("message", "$.uid").alias("uid"), "ts_ns",
        F.col("labels")["pod_name"].alias("pod_name"), "log_table",
    )


@query(
    "a13_read_alerts",
    "points",
    """SELECT src_order, ts_s * 1000000000 AS ts_ns, metric AS subject,
         '{"subject":"' || metric || '","status":"firing","severity":null,"resource":"' || container
         || '","labels":"' || src_order || '","annotations":null}' AS message FROM points""",
)
def alerts(t):
    rows = t.points.select(
        F.col("ts_s").alias("time_s"), F.col("metric").alias("subject"),
        F.lit("firing").alias("status"), F.lit(None).cast("string").alias("severity"),
        F.col("container").alias("resource"), F.col("src_order").cast("string").alias("labels"),
        F.lit(None).cast("string").alias("annotations"), F.lit("prom").alias("sourcetype"),
    )
    read = node_archive.read_alerts(t.spark, Archive(t).parquet("alerts.parquet", rows))
    return read.select(
        F.get_json_object("message", "$.labels").cast("bigint").alias("src_order"), "ts_ns",
        F.col("labels")["subject"].alias("subject"), "message",
    )


@query(
    "a14_read_json_spans",
    SPANS,
    """SELECT span_id, service_name, span_kind, status_code, peer, CASE WHEN span_name LIKE 'op%' THEN 1 ELSE 0 END
         ::BIGINT AS events, ts_ns, end_ns FROM spans""",
)
def json_spans(t):
    kinds = {"SPAN_KIND_CLIENT": 3, "SPAN_KIND_SERVER": 2}
    kind = F.lit(1)
    for name, code in kinds.items():
        kind = F.when(F.col("span_kind") == name, code).otherwise(kind)
    events = F.to_json(F.array(F.struct(F.lit("start").alias("name"))))
    rows = t.spans.select(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
        F.col("parent_span_id").alias("parentSpanId"), F.col("span_name").alias("spanName"),
        kind.alias("kind"), F.col("ts_ns").alias("startTime"), F.col("end_ns").alias("endTime"),
        F.col("service_name").alias("serviceName"),
        F.when(F.col("status_code") == "STATUS_CODE_ERROR", 2).otherwise(0).alias("statusCode"),
        F.lit("").alias("statusMessage"), F.lit("{}").alias("resources"),
        F.to_json(F.struct("peer")).alias("attributes"),
        F.when(F.col("span_name").startswith("op"), events).otherwise("").alias("events"),
    )
    read = node_archive.read_json_spans(t.spark, Archive(t).parquet("traces.parquet", rows))
    return read.select(
        "span_id", "service_name", "span_kind", "status_code",
        F.col("attributes")["peer"].alias("peer"), F.size("events").cast("bigint").alias("events"),
        "ts_ns", "end_ns",
    )


@query(
    "a15_read_topology",
    "",
    """SELECT 'entity' AS kind, c_custkey::VARCHAR AS a, c_name AS b FROM customer WHERE c_custkey % 10 > 0
       UNION ALL SELECT 'edge', o_custkey::VARCHAR, 'calls' FROM orders""",
)
def topology(t):
    """A folder of snapshot documents; an entity without id is left out."""
    entities = t.table("customer").select(
        F.struct(
            F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey").cast("string")).otherwise("").alias("id"),
            F.lit("apm.service").alias("type"),
            F.col("c_name").alias("name"),
        ).alias("e"),
        F.lit(None).cast("struct<src:string,dst:string,relation:string>").alias("d"),
    )
    edges = t.table("orders").select(
        F.lit(None).cast("struct<id:string,type:string,name:string>").alias("e"),
        F.struct(
            F.col("o_custkey").cast("string").alias("src"), F.lit("x").alias("dst"),
            F.lit("calls").alias("relation"),
        ).alias("d"),
    )
    documents = entities.unionByName(edges).select(
        F.array_compact(F.array("e")).alias("entities"), F.array_compact(F.array("d")).alias("edges")
    )
    path = Archive(t).json("topology", documents)
    entities_read, edges_read = case_files.read_topology(t.spark, path, one_per_file=False)
    return entities_read.select(
        F.lit("entity").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b")
    ).unionByName(
        edges_read.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("relation").alias("b"))
    )


@query(
    "a16_read_manifest",
    "",
    """SELECT c_name AS name, c_mktsegment AS root, CASE WHEN c_custkey % 3 = 0 THEN NULL
         ELSE c_custkey % 2 = 0 END AS hybrid FROM customer""",
)
def manifest(t):
    k = F.col("c_custkey")
    rows = t.table("customer").select(
        F.col("c_name").alias("name"), F.lit("hs").alias("system"),
        F.array("c_mktsegment").alias("root_services"), F.lit("PodFailure").alias("primary_kind"),
        F.when(k % 3 > 0, k % 2 == 0).alias("hybrid"), F.lit(1).alias("ignored"),
    )
    read = case_files.read_manifest(t.spark, Archive(t).json("manifest.jsonl", rows))
    return read.select("name", F.col("root_services")[0].alias("root"), "hybrid")


@query(
    "a17_read_ground_truth",
    "points",
    f"""SELECT 'fault' AS kind, container || '@' || ts_s AS value FROM points
          WHERE ts_s BETWEEN 1704412800 AND 1705276800
        UNION ALL SELECT DISTINCT 'reason', metric FROM points""",
)
def ground_truth(t):
    rows = t.points.select(
        F.lit("pod").alias("level"), F.col("container").alias("component"),
        F.concat(F.col("ts_s").cast("string"), F.lit(".0")).alias("timestamp"),
        F.lit("x").alias("datetime"), F.col("metric").alias("reason"),
    )
    path = Archive(t).csv("record.csv", rows)
    faults = csv_archive.read_ground_truth(t.spark, path, WINDOW).select(
        F.lit("fault").alias("kind"),
        F.concat_ws("@", "component", F.col("ts_s").cast("string")).alias("value"),
    )
    reasons = csv_archive.fault_reasons(t.spark, path)
    return faults.unionByName(
        reasons.select(F.lit("reason").alias("kind"), F.col("reason").alias("value"))
    )


def run_records(t):
    """Recorded runs as nested JSON: one run per user, calls from its events.

    The gathered array is the record's own content, not a grouping of this engine;
    runs of a user are cut by day so that a record stays small.
    """
    day = W.floor_div("started", 86400)
    call = F.struct(
        "ordinal", "query_id", "tool_name",
        F.create_map(F.lit("query"), "sql_text", F.lit("operation"), "operation").alias("input"),
        F.struct(F.col("result_query_id").alias("query_id"), "operation", "truncated").alias("output"),
        F.when(F.col("failed"), "timeout").alias("error"),
        F.when(
            F.col("rows_returned").isNotNull(), F.struct("rows_returned")
        ).alias("database_load"),
    )
    grouped = t.calls.groupBy("run_id", day.alias("day")).agg(
        F.array_sort(
            F.collect_list(call), lambda a, b: F.signum(a["ordinal"] - b["ordinal"]).cast("int")
        ).alias("tool_calls")
    )
    cited = F.array(
        F.struct(
            F.col("tool_calls")[0]["query_id"].alias("query_id"), F.lit("claim").alias("claim"),
            F.array(F.lit("causal_locus")).alias("claim_types"),
        )
    )
    return grouped.select(
        (F.col("run_id") * 100_000 + F.col("day")).alias("cell_index"),
        F.lit("m0").alias("model"), F.concat(F.lit("case"), "run_id").alias("case_id"),
        F.lit(1).alias("repetition"), F.lit("raw").alias("visibility"),
        F.struct(
            F.lit("m0").alias("model"), F.col("tool_calls"),
            F.when(F.size("tool_calls") > 1, F.struct(cited.alias("evidence"))).alias("diagnosis"),
            F.array(F.struct(F.lit('{"input_tokens":5}').alias("usage"))).alias("responses"),
            F.array(
                F.struct(F.lit("execute_sql").alias("tool_name"), F.lit("invalid").alias("reason_code"))
            ).alias("rejected_tool_calls"),
        ).alias("run"),
    )


@query(
    "a18_read_runs",
    "calls",
    """, c AS (SELECT *, run_id * 100000 + started // 86400 AS cell FROM calls)
       SELECT cell::VARCHAR AS run_id, count(*) AS calls, count(rows_returned) AS with_load,
         sum(rows_returned)::BIGINT AS rows_returned, count(CASE WHEN failed THEN 1 END) AS failed_calls,
         CASE WHEN count(*) > 1 THEN 1 ELSE 0 END::BIGINT AS citations FROM c GROUP BY cell""",
)
def recorded_runs(t):
    path = Archive(t).json("runs", run_records(t))
    runs = case_files.read_runs(t.spark, path)
    calls = case_files.run_calls(runs).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count("rows_returned").alias("with_load"),
        F.sum("rows_returned").alias("rows_returned"), F.count_if("failed").alias("failed_calls"),
    )
    cited = case_files.run_citations(runs).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("citations")
    )
    return calls.join(cited, "run_id", "left").na.fill(0, ["citations"])


@query(
    "a19_task_windows",
    "",
    """SELECT o_orderkey, epoch(o_orderdate)::BIGINT + (o_custkey % 23) * 3600 - 8 * 3600 AS window_start,
         epoch(o_orderdate)::BIGINT + (o_custkey % 23) * 3600 + 1800 - 8 * 3600 AS window_end FROM orders""",
)
def windows(t):
    hour = F.lpad((F.col("o_custkey") % 23).cast("string"), 2, "0")
    text = F.concat(
        F.lit("The system failed on "), F.date_format("o_orderdate", "MMMM d, yyyy"),
        F.lit(", from "), hour, F.lit(":00 to "), hour, F.lit(":30. Find the root cause."),
    )
    rows = t.table("orders").select("o_orderkey", text.alias("instruction"))
    return csv_archive.task_windows(rows).drop("instruction")


@query(
    "a20_flatten_discovery",
    "points",
    """, r AS (SELECT src_order, metric, container, k, k % 5 AS o FROM points)
       SELECT src_order, 'label_values' AS operation, NULL AS name, i AS at,
         CASE i WHEN 0 THEN metric ELSE container END AS item FROM r, range(0, 2) t(i) WHERE o = 0
       UNION ALL SELECT src_order, 'series', NULL, 0, container FROM r WHERE o = 1
       UNION ALL SELECT src_order, 'tags', NULL, 0, metric FROM r WHERE o = 2
       UNION ALL SELECT src_order, 'metadata', metric, i, container || i FROM r, range(0, 2) t(i) WHERE o = 3""",
)
def discovery(t):
    k = F.col("k") % 5

    def quoted(*parts):
        return F.concat(*[F.lit('"'), *parts, F.lit('"')])

    operation = (
        F.when(k == 0, "label_values").when(k == 1, "series").when(k == 2, "tags").when(k == 3, "metadata")
        .otherwise("search")
    )
    body = (
        F.when(k == 0, F.concat(F.lit('{"data":['), quoted("metric"), F.lit(","), quoted("container"), F.lit("]}")))
        .when(k == 1, F.concat(F.lit('{"data":[{"container":'), quoted("container"), F.lit("}]}")))
        .when(k == 2, F.concat(F.lit('{"scopes":['), quoted("metric"), F.lit("]}")))
        .when(k == 3, F.concat(F.lit('{"data":{'), quoted("metric"), F.lit(":["), quoted("container", F.lit("0")),
                               F.lit(","), quoted("container", F.lit("1")), F.lit("]}}")))
        .otherwise('{"traces":{}}')
    )
    rows = t.points.select("src_order", operation.alias("operation"), body.alias("body"))
    flat = responses.flatten_discovery(rows, "body")
    labels = responses.series_labels(F.col("item"))["container"]
    return flat.withColumn("item", F.when(F.col("operation") == "series", labels).otherwise(F.col("item")))


@query(
    "a20_flatten_matrix",
    "points",
    """SELECT src_order, i AS part, CASE WHEN k % 3 > 0 THEN metric END AS name,
         (ts_s + i)::DOUBLE AS timestamp, (k + i)::VARCHAR AS value
       FROM points, range(0, 3) r(i) WHERE i < CASE WHEN k % 3 = 2 THEN 3 ELSE 1 END""",
)
def matrix(t):
    k = F.col("k") % 3

    def sample(i):
        return F.concat(
            F.lit("["), F.col("ts_s") + i, F.lit(',"'), F.col("k") + i, F.lit('"]')
        )

    metric = F.concat(F.lit('{"metric":{"__name__":"'), "metric", F.lit('"},'))
    body = (
        F.when(k == 0, F.concat(F.lit('"scalar","result":'), sample(0)))
        .when(k == 1, F.concat(F.lit('"vector","result":['), metric, F.lit('"value":'), sample(0),
                               F.lit("}]")))
        .otherwise(
            F.concat(
                F.lit('"matrix","result":['), metric, F.lit('"values":['), sample(0), F.lit(","),
                sample(1), F.lit(","), sample(2), F.lit("]}]"),
            )
        )
    )
    text = F.concat(F.lit('{"status":"success","data":{"resultType":'), body, F.lit("}}"))
    rows = t.points.select("src_order", "ts_s", text.alias("body"))
    flat = responses.flatten_matrix(rows, "body")
    return flat.select(
        "src_order", (F.col("timestamp") - F.col("ts_s")).cast("bigint").alias("part"),
        F.col("labels")["__name__"].alias("name"), "timestamp", "value",
    )


@query(
    "a21_flatten_log_streams",
    "",
    """SELECT doc_id, e.n AS part, source AS stream, CASE WHEN e.n = 1 THEN 't' || doc_id END AS trace_id,
         CASE WHEN e.n = 1 THEN 'entry' ELSE 'stream' END AS level, doc_id * 1000 + e.n AS ts_ns,
         CASE WHEN e.n = 0 THEN text ELSE lang END AS line
       FROM documents, (VALUES (0::BIGINT), (1::BIGINT)) e(n)""",
)
def streams(t):
    doc = F.col("doc_id")

    def quoted(column):
        # A one-field object, cut open, is the JSON text of the value.
        return F.regexp_replace(
            F.regexp_replace(F.to_json(F.struct(column.alias("v"))), r'^\{"v":', ""), r"\}$", ""
        )

    entry = F.concat(
        F.lit('["'), doc * 1000, F.lit('",'), quoted(F.col("text")), F.lit('],["'), doc * 1000 + 1,
        F.lit('",'), quoted(F.col("lang")), F.lit(',{"trace_id":"t'), doc,
        F.lit('","level":"entry"}]'),
    )
    body = F.concat(
        F.lit('{"data":{"resultType":"streams","result":[{"stream":{"source":"'), "source",
        F.lit('","level":"stream"},"values":['), entry, F.lit("]}]}}"),
    )
    rows = t.table("documents").select("doc_id", body.alias("body"))
    flat = responses.flatten_log_streams(rows, "body")
    return flat.select(
        "doc_id", (F.col("ts_ns") % 1000).alias("part"),
        F.col("labels")["source"].alias("stream"), F.col("labels")["trace_id"].alias("trace_id"),
        F.col("labels")["level"].alias("level"), "ts_ns", "line",
    )


@query(
    "a22_flatten_trace_export",
    SPANS,
    """SELECT trace_id, span_id, parent_span_id, service_name, span_kind, status_code, ts_ns,
         (ts_ns % 7)::VARCHAR AS code, CASE WHEN peer IS NULL THEN 'false' ELSE 'true' END AS has_peer
       FROM spans""",
)
def export(t):
    def value(field, column):
        return F.struct(column.alias(field))

    attributes = F.concat(
        F.lit('[{"key":"code","value":{"intValue":"'), F.col("ts_ns") % 7,
        F.lit('"}},{"key":"has_peer","value":{"boolValue":'),
        F.when(F.col("peer").isNull(), "false").otherwise("true"), F.lit("}}]"),
    )

    def b64(column):
        return F.base64(F.unhex(column))

    body = F.concat(
        F.lit('{"batches":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'),
        "service_name", F.lit('"}}]},"scopeSpans":[{"scope":{"name":"replay","version":"1"},"spans":['),
        F.lit('{"traceId":"'), b64("trace_id"), F.lit('","spanId":"'), b64("span_id"),
        F.lit('","parentSpanId":"'), b64("parent_span_id"), F.lit('","name":"'), "span_name",
        F.lit('","kind":"'), "span_kind", F.lit('","startTimeUnixNano":"'), F.col("ts_ns"),
        F.lit('","endTimeUnixNano":"'), F.col("end_ns"), F.lit('","status":{"code":"'), "status_code",
        F.lit('"},"attributes":'), attributes, F.lit("}]}]}]}"),
    )
    flat = responses.flatten_trace_export(t.spans.select(body.alias("body")), "body")
    return flat.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "span_kind", "status_code", "ts_ns",
        F.col("attributes")["code"].alias("code"), F.col("attributes")["has_peer"].alias("has_peer"),
    )


@query(
    "a23_canonical_tables",
    "points",
    """SELECT 'metrics' AS signal, strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date,
         count(*) AS rows FROM points GROUP BY ALL
       UNION ALL SELECT 'logs', strftime(to_timestamp(doc_id * 600) AT TIME ZONE 'UTC', '%Y-%m-%d'), count(*)
       FROM documents GROUP BY ALL""",
)
def canonical(t):
    path = work_dir(t.spark, "canonical")
    sinks.write_telemetry(t.points.select("metric", "ts_ns", "value", "container"), path, "metrics")
    logs = t.table("documents").select(
        (F.col("doc_id") * 600 * F.lit(SECOND)).alias("ts_ns"), F.col("text").alias("message")
    )
    sinks.write_telemetry(logs, path, "logs")
    parts = [
        sinks.read_telemetry(t.spark, path, signal)
        .groupBy("signal", F.col("date").cast("string").alias("date"))
        .agg(F.count(F.lit(1)).alias("rows"))
        for signal in ("metrics", "logs")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "a24_report_artifact",
    "runs",
    """SELECT count(*) AS rows, sum(('0x' || substr(sha256(case_id || chr(31) || model || chr(31)
         || run_id || chr(31) || tool_calls), 1, 15))::BIGINT)::VARCHAR AS digest FROM runs""",
)
def report(t):
    table = t.runs.select("case_id", "model", "run_id", "tool_calls")
    return sinks.write_report(table, work_dir(t.spark, "report"), ["run_id"])
