"""Service graph queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.operators import callgraph as G
from faultline.plans.registry import ORACLES, query
from faultline.plans.views import BOUNDARY, SECOND, WINDOW
from faultline.session import work_dir
from faultline.sources import sinks

SPANS = "clients_src servers_src spans"
PAIRS = f"{SPANS} pairs"
RANGE = "observed_at >= 1704067200 AND observed_at < 1705276800"
EDGE_SQL = "src_type, src_id, dst_type, dst_id, rel_type, provenance"


def observed(t):
    return t.observations.where(W.half_open("observed_at", 1704067200, 1705276800))


@query(
    "e1_span_pairs",
    PAIRS,
    """SELECT trace_id, client_span_id, server_span_id, src_id, dst_id, client_ns, server_ns, error
       FROM pairs WHERE src_id <> dst_id""",
)
def span_pairs(t):
    return G.span_pairs(t.spans, WINDOW).select(
        "trace_id", "client_span_id", "server_span_id", "src_id", "dst_id", "client_ns",
        "server_ns", "error",
    )


@query(
    "e2_caller_pairs",
    PAIRS,
    """SELECT src_id, dst_id, count(*) AS request_count,
              sum(CASE WHEN error THEN 1 ELSE 0 END)::BIGINT AS error_count
       FROM pairs WHERE src_id = 'svc1' GROUP BY src_id, dst_id""",
)
def caller_pairs(t):
    """One caller; its calls to itself stay."""
    edges = G.call_edges(G.span_pairs(t.spans, WINDOW, exclude_self=False, caller="svc1"))
    return edges.select("src_id", "dst_id", "request_count", "error_count")


@query(
    "e3_unpaired_clients",
    SPANS,
    """SELECT c.trace_id, c.span_id, c.service_name FROM spans c
       WHERE c.span_kind = 'SPAN_KIND_CLIENT'
         AND c.ts_ns >= 560000 * 1000000000::BIGINT AND c.ts_ns < 680000 * 1000000000::BIGINT
         AND NOT EXISTS (SELECT 1 FROM spans s
           WHERE s.trace_id = c.trace_id AND s.parent_span_id = c.span_id
             AND s.span_kind = 'SPAN_KIND_SERVER'
             AND s.ts_ns >= c.ts_ns - 300 * 1000000000::BIGINT
             AND s.ts_ns <= c.ts_ns + 3600 * 1000000000::BIGINT)""",
)
def unpaired(t):
    return G.unpaired_clients(t.spans, WINDOW).select("trace_id", "span_id", "service_name")


@query(
    "e4_call_path_gaps",
    SPANS,
    """SELECT c.service_name AS src_id, s.service_name AS dst_id,
              CASE WHEN c.ts_ns < 620017 * 1000000000::BIGINT THEN 'normal' ELSE 'abnormal' END AS period,
              count(*) AS sample_count, min(s.ts_ns - c.ts_ns) AS min_value,
              max(s.ts_ns - c.ts_ns) AS max_value,
              sum(CASE WHEN s.ts_ns - c.ts_ns >= 500000000 THEN 1 ELSE 0 END)::BIGINT AS high_count
       FROM spans c JOIN spans s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
       WHERE c.span_kind = 'SPAN_KIND_CLIENT' AND s.span_kind = 'SPAN_KIND_SERVER'
         AND c.span_name IN ('1-URGENT', '2-HIGH', '5-LOW')
         AND c.ts_ns >= 560000 * 1000000000::BIGINT AND c.ts_ns < 680000 * 1000000000::BIGINT
       GROUP BY ALL""",
)
def call_path_gaps(t):
    gaps = G.call_gaps(t.spans, WINDOW, ["1-URGENT", "2-HIGH", "5-LOW"])
    period = W.period_by_boundary("client_ns", BOUNDARY * SECOND)
    return gaps.groupBy("src_id", "dst_id", period.alias("period")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("gap_ns").alias("min_value"),
        F.max("gap_ns").alias("max_value"),
        F.count_if(F.col("gap_ns") >= 500_000_000).alias("high_count"),
    )


@query(
    "e5_sole_server_gaps",
    SPANS,
    """, tagged AS (SELECT *, CASE
           WHEN ts_ns >= 560000 * 1000000000::BIGINT AND ts_ns < 620017 * 1000000000::BIGINT THEN 'normal'
           WHEN ts_ns >= 620017 * 1000000000::BIGINT AND ts_ns < 680000 * 1000000000::BIGINT THEN 'abnormal' END
           AS period FROM spans)
       SELECT c.trace_id, c.period, c.service_name AS src_id, s.service_name AS dst_id,
              min(s.ts_ns) - c.ts_ns AS gap_ns
       FROM tagged c JOIN tagged s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
        AND c.period = s.period
       WHERE c.span_kind = 'SPAN_KIND_CLIENT' AND s.span_kind = 'SPAN_KIND_SERVER'
       GROUP BY c.trace_id, c.period, c.service_name, s.service_name, c.span_id, c.ts_ns
       HAVING count(*) = 1""",
)
def sole_gaps(t):
    period = W.period_of("ts_ns", WINDOW[0] * SECOND, BOUNDARY * SECOND, WINDOW[1] * SECOND)
    return G.sole_server_gaps(t.spans, period).select(
        "trace_id", "period", "src_id", "dst_id", "gap_ns"
    )


def causal_targets(t):
    """One case per nation: every third is an edge case, the others name a service."""
    n = F.col("n_nationkey")
    service = F.concat(F.lit("svc"), n % 5)
    edge = n % 3 == 0
    return t.table("nation").select(
        F.col("n_name").alias("case_id"),
        F.when(~edge, service).alias("service"),
        F.when(edge, service).alias("edge_source"),
        F.when(edge, F.concat(F.lit("svc"), (n + 1) % 5)).alias("edge_destination"),
    )


@query(
    "e6_causal_traces",
    SPANS,
    """, targets AS (SELECT n_name AS case_id, n_nationkey AS n FROM nation),
       hits AS (
       SELECT DISTINCT t.case_id, c.trace_id FROM targets t
       JOIN spans c ON t.n % 3 = 0 AND c.service_name = 'svc' || (t.n % 5)
        AND c.span_kind = 'SPAN_KIND_CLIENT'
       JOIN spans s ON s.service_name = 'svc' || ((t.n + 1) % 5)
        AND s.trace_id = c.trace_id AND s.parent_span_id = c.span_id
        AND s.span_kind = 'SPAN_KIND_SERVER'
       UNION ALL
       SELECT DISTINCT t.case_id, c.trace_id FROM targets t
       JOIN spans c ON t.n % 3 <> 0 AND c.service_name = 'svc' || (t.n % 5))
       SELECT case_id, count(*) AS traces, min(trace_id) AS first_trace, max(trace_id) AS last_trace
       FROM hits GROUP BY case_id""",
)
def causal(t):
    return (
        G.causal_traces(t.spans, causal_targets(t))
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("traces"),
            F.min("trace_id").alias("first_trace"),
            F.max("trace_id").alias("last_trace"),
        )
    )


def reference_topology(t):
    n = F.col("n_nationkey")
    return t.table("nation").select(
        F.concat(F.lit("svc"), n % 6).alias("src_id"),
        F.concat(F.lit("svc"), F.floor(n / 6).cast("int")).alias("dst_id"),
    )


@query(
    "e7_compare_topology",
    PAIRS,
    """, d AS (SELECT DISTINCT src_id, dst_id FROM pairs WHERE src_id <> dst_id),
       r AS (SELECT DISTINCT 'svc' || (n_nationkey % 6) AS src_id,
                    'svc' || (n_nationkey // 6) AS dst_id FROM nation)
       SELECT coalesce(d.src_id, r.src_id) AS src_id, coalesce(d.dst_id, r.dst_id) AS dst_id,
              CASE WHEN d.src_id IS NOT NULL AND r.src_id IS NOT NULL THEN 'found'
                   WHEN r.src_id IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
       FROM d FULL OUTER JOIN r ON d.src_id = r.src_id AND d.dst_id = r.dst_id""",
)
def topology(t):
    return G.compare_topology(G.span_pairs(t.spans, WINDOW), reference_topology(t))


@query(
    "e8_typed_calls",
    "",
    """WITH entities AS (
         SELECT c_custkey AS id, c_name AS name,
                CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'host' ELSE 'apm.service' END AS type
         FROM customer),
       edges AS (
         SELECT o_custkey AS src, (o_orderkey % (o_custkey + 1)) AS dst,
                CASE WHEN o_orderstatus = 'F' THEN 'runs_on' ELSE 'calls' END AS relation
         FROM orders)
       SELECT DISTINCT a.name AS src_id, b.name AS dst_id FROM edges e
       JOIN entities a ON a.id = e.src JOIN entities b ON b.id = e.dst
       WHERE e.relation = 'calls' AND a.type = 'apm.service' AND b.type = 'apm.service'""",
)
def typed(t):
    entities = t.table("customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "host").otherwise("apm.service").alias("type"),
    )
    edges = t.table("orders").select(
        F.col("o_custkey").alias("src"),
        (F.col("o_orderkey") % (F.col("o_custkey") + 1)).alias("dst"),
        F.when(F.col("o_orderstatus") == "F", "runs_on").otherwise("calls").alias("relation"),
    )
    return G.typed_calls(entities, edges)


@query(
    "f1_red_edges",
    PAIRS,
    """SELECT 'service' AS src_type, src_id, 'service' AS dst_type, dst_id, 'calls' AS rel_type,
              'trace' AS provenance, count(*) AS request_count,
              sum(CASE WHEN error THEN 1 ELSE 0 END)::BIGINT AS error_count
       FROM pairs WHERE src_id <> dst_id GROUP BY src_id, dst_id""",
)
def red_edges(t):
    return G.call_edges(G.span_pairs(t.spans, WINDOW))


@query(
    "f2_edge_observations",
    PAIRS,
    """, lonely AS (SELECT * FROM spans c
         WHERE c.span_kind = 'SPAN_KIND_CLIENT' AND c.peer IS NOT NULL
           AND c.ts_ns >= 560000 * 1000000000::BIGINT AND c.ts_ns < 680000 * 1000000000::BIGINT
           AND NOT EXISTS (SELECT 1 FROM spans s
             WHERE s.trace_id = c.trace_id AND s.parent_span_id = c.span_id
               AND s.span_kind = 'SPAN_KIND_SERVER'
               AND s.ts_ns >= c.ts_ns - 300 * 1000000000::BIGINT
               AND s.ts_ns <= c.ts_ns + 3600 * 1000000000::BIGINT))
       SELECT (client_ns // 60000000000) * 60 AS window_start, src_id, dst_id,
              1.0::DOUBLE AS confidence, count(*) AS request_count, 0::BIGINT AS unmatched_count,
              sum(CASE WHEN error THEN 1 ELSE 0 END)::BIGINT AS error_count,
              sum(server_end_ns - server_ns)::DOUBLE AS duration_sum,
              count(server_end_ns - server_ns) AS duration_count,
              max(server_end_ns - server_ns)::DOUBLE AS duration_max
       FROM pairs WHERE src_id <> dst_id GROUP BY ALL
       UNION ALL
       SELECT (ts_ns // 60000000000) * 60, service_name, peer, 0.5::DOUBLE, count(*), count(*),
              0::BIGINT, NULL::DOUBLE, 0::BIGINT, NULL::DOUBLE
       FROM lonely GROUP BY 1, 2, 3""",
)
def observations(t):
    return G.edge_observations(t.spans, WINDOW, peer="peer").select(
        "window_start", "src_id", "dst_id", "confidence", "request_count", "unmatched_count",
        "error_count", "duration_sum", "duration_count", "duration_max",
    )


MAXES = """max(confidence) AS confidence, max(request_count) AS request_count,
 max(unmatched_count) AS unmatched_count, max(error_count) AS error_count,
 max(duration_sum) AS duration_sum, max(duration_count) AS duration_count,
 max(duration_max) AS duration_max"""


@query(
    "f3_window_relationships",
    "observations",
    f"""SELECT window_start, window_end, {EDGE_SQL}, attributes, {MAXES}
        FROM observations WHERE {RANGE} GROUP BY window_start, window_end, {EDGE_SQL}, attributes""",
)
def window_relationships(t):
    return G.window_relationships(observed(t), "attributes")


@query(
    "f4_range_relationships",
    "observations",
    f""", w AS (SELECT window_start, window_end, {EDGE_SQL}, {MAXES}
          FROM observations WHERE {RANGE} GROUP BY window_start, window_end, {EDGE_SQL})
        SELECT {EDGE_SQL}, max(confidence) AS confidence,
               sum(request_count)::BIGINT AS request_count,
               sum(unmatched_count)::BIGINT AS unmatched_count,
               sum(error_count)::BIGINT AS error_count,
               round(sum(duration_sum), 4) AS duration_sum,
               sum(duration_count)::BIGINT AS duration_count, max(duration_max) AS duration_max
        FROM w GROUP BY {EDGE_SQL}""",
)
def range_relationships(t):
    return G.range_relationships(observed(t)).withColumn(
        "duration_sum", F.round("duration_sum", 4)
    )


ENTITY_SQL = "entity_type, entity_id, entity_id_attrs, scope, descriptive, source_tables"


@query(
    "f5_entity_snapshots",
    "entities",
    f"""SELECT {ENTITY_SQL}, min(observed_at) AS first_observed_at,
               max(observed_at) AS latest_observed_at, max(fresh_until) AS fresh_until
        FROM entities WHERE {RANGE} GROUP BY {ENTITY_SQL}""",
)
def entity_snapshots(t):
    return G.entity_snapshots(t.entities.where(RANGE))


@query(
    "f5_entity_windows",
    "entities",
    f"""SELECT window_start, window_end, {ENTITY_SQL}, max(fresh_until) AS fresh_until
        FROM entities WHERE {RANGE} GROUP BY window_start, window_end, {ENTITY_SQL}""",
)
def entity_windows(t):
    return G.entity_snapshots(t.entities.where(RANGE), bucket="window")


@query(
    "f6_paired_edges",
    "observations",
    f"""SELECT {EDGE_SQL}, sum(request_count)::BIGINT AS request_count,
               sum(error_count)::BIGINT AS error_count FROM observations
        WHERE src_type = 'service' AND dst_type = 'service' AND rel_type = 'calls'
          AND provenance = 'trace' AND confidence = 1.0 AND {RANGE} GROUP BY {EDGE_SQL}""",
)
def paired(t):
    return G.paired_edges(observed(t))


@query(
    "f7_virtual_edges",
    "observations",
    f"""SELECT src_id, dst_id, max(confidence) AS confidence,
               sum(request_count)::BIGINT AS request_count,
               sum(unmatched_count)::BIGINT AS unmatched_count FROM observations
        WHERE rel_type = 'calls' AND provenance = 'trace' AND confidence < 1.0 AND {RANGE}
        GROUP BY src_id, dst_id""",
)
def virtual(t):
    return G.virtual_edges(observed(t))


@query(
    "f8_client_minutes",
    SPANS,
    """SELECT (ts_ns // 60000000000) * 60 AS minute, count(*) AS client_spans FROM spans
       WHERE span_kind = 'SPAN_KIND_CLIENT' GROUP BY 1""",
)
def client_minutes(t):
    return G.client_minutes(t.spans)


COVERAGE_E = f"""SELECT entity_type, count(DISTINCT entity_id) AS distinct_entity_count,
 count(*) AS observation_count, count(scope) AS scoped_observation_count
 FROM entities WHERE {RANGE} GROUP BY entity_type"""
COVERAGE_R = f"""SELECT rel_type, count(*) AS distinct_relationship_count,
 sum(n)::BIGINT AS observation_count, max(u) AS max_window_unmatched_count,
 max(d) AS max_request_duration
 FROM (SELECT {EDGE_SQL}, count(*) AS n, max(unmatched_count) AS u, max(duration_max) AS d
       FROM observations WHERE {RANGE} GROUP BY {EDGE_SQL}) GROUP BY rel_type"""


@query("f9_entity_coverage", "entities", COVERAGE_E)
def entity_coverage(t):
    return G.entity_coverage(t.entities.where(RANGE))


@query("f10_relationship_coverage", "observations", COVERAGE_R)
def relationship_coverage(t):
    return G.relationship_coverage(observed(t))


@query(
    "f11_graph_status",
    "observations entities",
    f""", e AS ({COVERAGE_E}), r AS ({COVERAGE_R})
        SELECT CASE WHEN rc > 0 THEN 'relational' WHEN ec > 0 THEN 'entity-only' ELSE 'empty' END
                 AS status, ec AS distinct_entity_count, rc AS distinct_relationship_count,
               oc AS relationship_observation_count, true AS entity_scope_queryable,
               false AS table_entity_declarations_queryable,
               true AS relationship_unmatched_count_queryable,
               true AS relationship_duration_max_queryable
        FROM (SELECT (SELECT sum(distinct_entity_count)::BIGINT FROM e) AS ec,
                     (SELECT sum(distinct_relationship_count)::BIGINT FROM r) AS rc,
                     (SELECT sum(observation_count)::BIGINT FROM r) AS oc)""",
)
def status(t):
    return G.graph_status(
        G.entity_coverage(t.entities.where(RANGE)), G.relationship_coverage(observed(t))
    )


@query(
    "f32_unique_winner",
    PAIRS,
    """, e AS (SELECT src_id, dst_id, count(*) AS requests,
                 sum(CASE WHEN error THEN 1 ELSE 0 END)::BIGINT AS errors
          FROM pairs WHERE src_id <> dst_id GROUP BY src_id, dst_id),
       m AS (SELECT src_id, max(errors) AS top FROM e GROUP BY src_id),
       w AS (SELECT e.src_id, count(*) AS n, min(dst_id) AS dst, min(requests) AS requests,
                    min(top) AS top
             FROM e JOIN m ON e.src_id = m.src_id AND e.errors = m.top GROUP BY e.src_id)
       SELECT src_id, CASE WHEN n = 1 THEN dst END AS winner,
              CASE WHEN n = 1 THEN requests END AS request_count,
              CASE WHEN n = 1 THEN top END AS error_count FROM w""",
)
def winner(t):
    return G.unique_winner(G.call_edges(G.span_pairs(t.spans, WINDOW)))


@query("d10_distinct_edges", "observations", f"SELECT DISTINCT {EDGE_SQL} FROM observations")
def distinct_edges(t):
    return G.distinct_edges(t.observations)


@query(
    "e13_two_hop_paths",
    "observations",
    f""", e AS (SELECT DISTINCT src_id, dst_id FROM observations WHERE {RANGE})
        SELECT a.src_id, count(DISTINCT a.dst_id) AS middles, count(*) AS paths
        FROM e a JOIN e b ON a.dst_id = b.src_id GROUP BY a.src_id""",
)
def two_hops(t):
    return G.two_hop_paths(t.observations, (1704067200, 1705276800))


@query(
    "e13_two_hop_from",
    "observations",
    f""", e AS (SELECT DISTINCT src_id, dst_id FROM observations WHERE {RANGE})
        SELECT DISTINCT b.dst_id FROM e a JOIN e b ON a.dst_id = b.src_id
        WHERE a.src_id = 'svc8'""",
)
def two_hops_from(t):
    return G.two_hop_from(t.observations, (1704067200, 1705276800), "svc8")


@query(
    "e14_entity_telemetry",
    "observations entities",
    """, ends AS (SELECT entity_type, entity_id, sum(o)::BIGINT AS outgoing,
                    sum(i)::BIGINT AS incoming FROM (
            SELECT 'view' AS entity_type, replace(src_id, 'svc', 'e') AS entity_id, 1 AS o, 0 AS i
            FROM observations UNION ALL
            SELECT 'view', replace(dst_id, 'svc', 'e'), 0, 1 FROM observations) GROUP BY ALL),
          r AS (SELECT 'metrics_' || event_type AS source_table, 'e' || (user_id % 40) AS entity_id,
                       count(*) AS telemetry_rows FROM events GROUP BY ALL)
       SELECT n.entity_type, n.entity_id, n.source_table, outgoing, incoming, telemetry_rows
       FROM (SELECT DISTINCT entity_type, entity_id, source_tables AS source_table FROM entities) n
       JOIN ends ON n.entity_type = ends.entity_type AND n.entity_id = ends.entity_id
       JOIN r ON r.source_table = n.source_table AND r.entity_id = n.entity_id""",
)
def entity_rows(t):
    entities = t.entities.withColumnRenamed("source_tables", "source_table")
    edges = t.observations.select(
        F.lit("view").alias("src_type"),
        F.replace("src_id", F.lit("svc"), F.lit("e")).alias("src_id"),
        F.lit("view").alias("dst_type"),
        F.replace("dst_id", F.lit("svc"), F.lit("e")).alias("dst_id"),
    )
    telemetry = t.events.select(
        F.concat(F.lit("metrics_"), "event_type").alias("source_table"),
        F.concat(F.lit("e"), F.col("user_id") % 40).alias("entity_id"),
    )
    return G.entity_telemetry(entities, edges, telemetry)


def correlated_logs(t):
    """Documents as log lines written inside of a client span."""
    key = F.col("doc_id") * 7
    return t.table("documents").select(
        "doc_id",
        F.lpad(F.lower(F.hex(key + 1)), 32, "0").alias("trace_id"),
        F.lpad(F.lower(F.hex(key + 1)), 16, "0").alias("span_id"),
        F.col("text").alias("message"),
    )


LOGS_SQL = """logs AS (SELECT doc_id, lpad(lower(to_hex(doc_id * 7 + 1)), 32, '0') AS trace_id,
 lpad(lower(to_hex(doc_id * 7 + 1)), 16, '0') AS span_id, text AS message FROM documents)"""


@query(
    "e15_correlate_logs",
    SPANS,
    f""", {LOGS_SQL} SELECT l.doc_id, s.service_name AS span_service, s.status_code,
            length(l.message) AS message_chars
          FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""",
)
def logs_in_spans(t):
    return G.correlate_logs(correlated_logs(t), t.spans).select(
        "doc_id", "span_service", "status_code", F.length("message").alias("message_chars")
    )


@query(
    "e15_trace_signal_counts",
    SPANS,
    f""", {LOGS_SQL}, l AS (SELECT trace_id, count(*) AS log_records FROM logs GROUP BY trace_id),
          s AS (SELECT trace_id, count(*) AS spans,
                  sum(CASE WHEN status_code = 'STATUS_CODE_ERROR' THEN 1 ELSE 0 END)::BIGINT
                  AS error_spans FROM spans GROUP BY trace_id)
          SELECT l.trace_id, log_records, spans, error_spans FROM l JOIN s ON l.trace_id = s.trace_id""",
)
def signal_counts(t):
    return G.trace_signal_counts(correlated_logs(t), t.spans)


class StoredSpans:
    """The spans as a table that pairing reads without a shuffle."""

    def __init__(self, t):
        path = work_dir(t.spans.sparkSession, "spans")
        buckets = sinks.span_buckets(t.spans)
        self.spans = sinks.write_spans(t.spans, f"spans_{uuid.uuid4().hex}", path, buckets)


# The same questions to the stored table: equal rows, no Exchange before or after the join.
STORED = {
    "e1_span_pairs": span_pairs, "e2_caller_pairs": caller_pairs, "e3_unpaired_clients": unpaired,
    "e5_sole_server_gaps": sole_gaps, "f1_red_edges": red_edges, "f2_edge_observations": observations,
}
for name, build in STORED.items():
    query(f"{name}_stored")(lambda t, build=build: build(StoredSpans(t)))
    ORACLES[f"{name}_stored"] = ORACLES[name]
