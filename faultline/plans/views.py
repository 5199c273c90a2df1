"""Telemetry and investigation views over the driver's tables.

Every view exists twice: as a DataFrame (method of `Tables`) and as SQL text
(`SQL`), so that a query and its twin start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import windows as W
SECOND = 1_000_000_000
# One calendar day of the order tables is one minute of span time, so that the
# server bounds of five minutes and one hour apply as they are.
WINDOW = (560_000, 680_000)
BOUNDARY = 620_017
# Incident windows on the event stream.
EVENTS_START, EVENTS_BOUNDARY, EVENTS_END = 1704067200, 1705276800, 1706659200

SQL = {
    "clients_src": """
SELECT lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id,
       lpad(lower(to_hex(o_orderkey + 1)), 16, '0') AS span_id,
       '' AS parent_span_id,
       'svc' || (o_custkey % 5) AS service_name,
       'SPAN_KIND_CLIENT' AS span_kind,
       'STATUS_CODE_UNSET' AS status_code,
       o_orderpriority AS span_name,
       (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 60 + o_orderkey % 60)::BIGINT
         * 1000000000::BIGINT AS ts_ns,
       (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 60 + o_orderkey % 60)::BIGINT
         * 1000000000::BIGINT + 500000000 AS end_ns,
       CASE WHEN o_custkey % 4 = 0 THEN 'ext' || (o_custkey % 3) END AS peer
FROM orders""",
    "servers_src": """
SELECT lpad(lower(to_hex(l_orderkey + 1)), 32, '0') AS trace_id,
       lpad(lower(to_hex(l_orderkey * 8 + l_linenumber)), 16, 'f') AS span_id,
       lpad(lower(to_hex(l_orderkey + 1)), 16, '0') AS parent_span_id,
       'svc' || (l_suppkey % 5) AS service_name,
       CASE WHEN l_returnflag = 'N' THEN 'SPAN_KIND_INTERNAL' ELSE 'SPAN_KIND_SERVER' END
         AS span_kind,
       CASE WHEN l_linestatus = 'F' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END
         AS status_code,
       'op' || (l_partkey % 7) AS span_name,
       (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 60 + l_orderkey % 60
         + l_linenumber)::BIGINT * 1000000000::BIGINT AS ts_ns,
       (date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 60 + l_orderkey % 60
         + l_linenumber)::BIGINT * 1000000000::BIGINT + l_quantity::BIGINT * 1000000 AS end_ns,
       NULL::VARCHAR AS peer
FROM lineitem""",
    "spans": "SELECT * FROM clients_src UNION ALL SELECT * FROM servers_src",
    "pairs": """
SELECT c.trace_id, c.span_id AS client_span_id, s.span_id AS server_span_id,
       c.service_name AS src_id, s.service_name AS dst_id, c.ts_ns AS client_ns,
       s.ts_ns AS server_ns, s.end_ns AS server_end_ns,
       s.status_code = 'STATUS_CODE_ERROR' AS error, c.span_name AS client_operation
FROM clients_src c JOIN servers_src s
  ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
 AND s.ts_ns >= c.ts_ns - 300 * 1000000000::BIGINT AND s.ts_ns <= c.ts_ns + 3600 * 1000000000::BIGINT
WHERE s.span_kind = 'SPAN_KIND_SERVER'
  AND c.ts_ns >= 560000 * 1000000000::BIGINT AND c.ts_ns < 680000 * 1000000000::BIGINT
  AND s.ts_ns >= (560000 - 300) * 1000000000::BIGINT AND s.ts_ns < (680000 + 3600) * 1000000000::BIGINT""",
    # Observations with repeats per window and edge, from the event stream.
    "observations": """
SELECT (epoch_us(ts) // 3600000000) * 3600 AS window_start,
       (epoch_us(ts) // 3600000000) * 3600 + 3600 AS window_end,
       (epoch_us(ts) // 1000000) AS observed_at,
       'service' AS src_type, 'svc' || (user_id % 9) AS src_id,
       CASE WHEN k % 11 = 0 THEN 'database' ELSE 'service' END AS dst_type,
       'svc' || (k % 7) AS dst_id,
       CASE WHEN event_type = 'signup' THEN 'runs_on' ELSE 'calls' END AS rel_type,
       CASE WHEN event_type = 'click' THEN 'config' ELSE 'trace' END AS provenance,
       'attr' || (k % 2) AS attributes,
       CASE WHEN k % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
       (k + 1)::BIGINT AS request_count, (k % 4)::BIGINT AS unmatched_count,
       (k % 3)::BIGINT AS error_count, value AS duration_sum,
       (k + 1)::BIGINT AS duration_count, value / 2 AS duration_max
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "entities": """
SELECT (epoch_us(ts) // 3600000000) * 3600 AS window_start,
       (epoch_us(ts) // 3600000000) * 3600 + 3600 AS window_end,
       event_type AS entity_type, 'e' || (user_id % 40) AS entity_id,
       'id' AS entity_id_attrs, CASE WHEN user_id % 3 = 0 THEN 'ns' || (user_id % 2) END AS scope,
       'v' || (k % 2) AS descriptive, 'metrics_' || event_type AS source_tables,
       (epoch_us(ts) // 1000000) AS observed_at,
       (epoch_us(ts) // 1000000) + 600 AS fresh_until
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    # Metric points with workload identities, from the event stream.
    "points": """
SELECT event_type AS metric, epoch_us(ts) * 1000 AS ts_ns,
       (epoch_us(ts) // 1000000) AS ts_s, value, event_id AS src_order,
       'c' || (user_id % 20) AS container, 'p' || (user_id % 20) AS pod,
       'd' || (user_id % 10) AS deployment, 'svc' || (user_id % 5) AS service_name,
       'ns' || (user_id % 2) AS namespace, user_id,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""",
    # Node telemetry archived per case, one day being one time unit.
    "node_telemetry": """
SELECT l_suppkey AS case_id, l_returnflag AS metric, 'n' || (l_partkey % 5) AS node,
       date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS ts, l_quantity AS value
FROM lineitem""",
    "node_cases": """
SELECT s_suppkey AS case_id, ['A', 'N', 'R'][(s_suppkey % 3 + 1)::INTEGER] AS metric,
       'n' || (s_nationkey % 5) AS node, 49.0 AS threshold,
       (10000 + (s_suppkey % 10) * 100)::BIGINT AS alert,
       (10300 + (s_suppkey % 10) * 100)::BIGINT AS window_end
FROM supplier""",
    # Aggregates as investigations submit them, with missing columns and units.
    "submitted": """
SELECT l_suppkey AS case_id, l_linenumber AS part,
       CASE WHEN l_linenumber <= 3 THEN 'normal'
            WHEN l_linenumber = 4 AND l_suppkey % 5 = 0 THEN NULL ELSE 'abnormal' END AS period,
       count(*) AS n,
       CASE WHEN l_suppkey % 3 <> 0 THEN min(l_quantity) / 1024 END AS lo,
       CASE WHEN l_suppkey % 7 <> 0 THEN max(l_quantity) / 1024 END AS hi,
       CASE WHEN l_suppkey % 4 <> 0 THEN sum(l_quantity) / count(*) / 1024 END AS mean,
       1024.0::DOUBLE AS scale, (CASE WHEN l_suppkey % 2 = 0 THEN 48 ELSE 50.5 END)::DOUBLE
         AS threshold
FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    # Evaluated runs of a measurement: model x case x repetition x treatment.
    "runs": """
SELECT model, case_id, repetition, treatment,
       model || '/' || case_id || '/' || repetition || '/' || treatment AS run_id,
       n AS tool_calls, CASE WHEN p % 17 > 0 THEN q END AS rows_returned,
       CASE WHEN s % 19 > 0 THEN s END AS input_tokens, p AS output_tokens,
       CASE WHEN model <> 'm2' OR p % 5 > 0 THEN p / 1000.0::DOUBLE END AS cost,
       CASE WHEN model = 'm3' THEN 'CNY' ELSE 'USD' END AS currency,
       s % 10 > 0 AS causal_scope_match, s % 9 > 0 AS causal_locus_match,
       s % 7 > 0 AS fault_category_match, p % 8 > 0 AS mechanism_code_match,
       n % 5 AS valid_evidence_count, n % 5 + s % 2 AS cited_evidence_count,
       s % 23 = 0 AS runner_error, s % 29 = 0 AS tool_budget_exhausted,
       s % 6 AS failed_queries, s % 4 AS rejected_calls,
       CASE WHEN treatment <> 'split' THEN p % 2 = 0 END AS required_evidence_covered,
       s % 10 > 0 AND s % 9 > 0 AND s % 7 > 0 AND p % 8 > 0 AS diagnosis_correct,
       s % 10 > 0 AND s % 9 > 0 AND s % 7 > 0 AND p % 8 > 0 AND n % 5 > 0 AND s % 23 > 0
         AND s % 29 > 0 AS eligible,
       n % 5 > 0 AND s % 2 = 0 AS citations_execution_valid, s % 11 > 0 AS typed_evidence
FROM (SELECT 'm' || (l_partkey % 4) AS model, l_suppkey AS case_id, l_linenumber AS repetition,
        CASE l_returnflag WHEN 'A' THEN 'split' WHEN 'N' THEN 'raw' ELSE 'graph' END AS treatment,
        count(*) AS n, sum(l_quantity)::BIGINT AS q, sum(l_orderkey)::BIGINT AS s,
        sum(l_partkey)::BIGINT AS p
      FROM lineitem GROUP BY ALL)""",
    "case_table": """
SELECT s_suppkey AS case_id, 'd' || (s_nationkey % 3) AS dataset,
       ['component', 'dependency_edge', 'infrastructure_node'][(s_suppkey % 3 + 1)::INTEGER]
         AS causal_scope, 'mech' || (s_suppkey % 6) AS mechanism_code
FROM supplier""",
    # Tool calls of recorded runs, from the event stream.
    "calls": """
SELECT user_id AS run_id, event_id AS ordinal, 'q' || k AS query_id,
       CASE event_type WHEN 'view' THEN 'execute_sql' WHEN 'click' THEN 'query_metrics'
         WHEN 'error' THEN 'query_logs' WHEN 'signup' THEN 'describe_table'
         ELSE 'query_semantic_graph' END AS tool_name,
       CASE WHEN k % 2 = 0 THEN 'query_range' ELSE 'labels' END AS operation,
       k % 9 = 0 AS failed,
       CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'q' || k END AS result_query_id,
       event_id % 11 = 0 AS truncated,
       CASE WHEN k % 8 = 0 THEN [] WHEN k % 3 = 0 THEN ['logs'] WHEN k % 3 = 1
         THEN ['logs', 'Traces'] ELSE ['cpu'] END AS base_tables,
       CASE WHEN event_id % 17 > 0 THEN floor(value)::BIGINT END AS rows_returned,
       CASE k % 4 WHEN 0 THEN 'SELECT * FROM a JOIN b' WHEN 1 THEN 'show tables'
         WHEN 2 THEN 'SELECT 1 FROM information_schema.tables' ELSE 'SELECT joined FROM x' END
         AS sql_text,
       CASE user_id % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'raw' ELSE 'graph' END AS treatment,
       (epoch_us(ts) // 1000000) AS started, floor(value)::BIGINT * 60 AS elapsed
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    # Citations of the same runs, from the documents.
    "citations": """
SELECT doc_id % 150 AS run_id, doc_id AS ordinal, 'q' || (n_chars % 100) AS query_id,
       CASE WHEN doc_id % 10 = 0 THEN '   ' ELSE text END AS claim,
       CASE doc_id % 8 WHEN 3 THEN ['causal_locus', 'causal_locus'] WHEN 7 THEN []
         WHEN 1 THEN ['causal_locus', 'fault_mechanism'] WHEN 2 THEN ['causal_locus']
         ELSE ['fault_mechanism'] END AS claim_types
FROM documents""",
    # The folded calls and the resolved citations, used by several queries.
    "folded_calls": """
SELECT run_id, query_id, count(*) AS n, min(ordinal) AS ordinal, min(tool_name) AS tool,
       bool_and((CASE tool_name WHEN 'query_metrics' THEN operation IN ('query', 'query_range')
                  WHEN 'query_logs' THEN operation = 'query_range'
                  WHEN 'execute_sql' THEN len(base_tables) > 0
                  WHEN 'query_semantic_graph' THEN true ELSE false END)
                AND NOT failed AND result_query_id = query_id AND NOT truncated) AS valid
FROM calls GROUP BY run_id, query_id""",
    "resolved": """
SELECT c.*, coalesce(f.n, 0) AS matches,
       CASE WHEN f.n IS NULL THEN 'missing' WHEN f.n = 1 THEN 'unique' ELSE 'ambiguous' END
         AS resolution,
       coalesce(f.n = 1 AND f.valid, false) AND trim(claim) <> '' AS execution_valid,
       coalesce(f.n = 1 AND f.valid, false) AS call_valid,
       CASE WHEN f.n = 1 THEN f.ordinal END AS call_ordinal, CASE WHEN f.n = 1 THEN f.tool END AS tool
FROM citations c LEFT JOIN folded_calls f ON c.run_id = f.run_id AND c.query_id = f.query_id""",
    # Samples with repeated keys: time cut to the hour.
    "samples": """
SELECT metric, (ts_s // 3600) * 3600000 AS ts_ms, container, value, src_order, k
FROM points""",
}


def with_views(tables: str, body: str) -> str:
    """`body` behind CTEs for the named views; it may go on with `, x AS (...) SELECT`."""
    names = tables.split()
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({SQL[name].strip()}\n)" for name in names)
    return f"WITH {ctes}\n{body.strip()}"


def _hex(value: Column, width: int, pad: str = "0") -> Column:
    return F.lpad(F.lower(F.hex(value)), width, pad)


def _days(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date")).cast("bigint")


class Tables:
    """DataFrame twins of `SQL` over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clients_src(self) -> DataFrame:
        key = F.col("o_orderkey")
        ts = (_days("o_orderdate") * 60 + key % 60) * F.lit(SECOND)
        return self.table("orders").select(
            _hex(key + 1, 32).alias("trace_id"),
            _hex(key + 1, 16).alias("span_id"),
            F.lit("").alias("parent_span_id"),
            F.concat(F.lit("svc"), F.col("o_custkey") % 5).alias("service_name"),
            F.lit("SPAN_KIND_CLIENT").alias("span_kind"),
            F.lit("STATUS_CODE_UNSET").alias("status_code"),
            F.col("o_orderpriority").alias("span_name"),
            ts.alias("ts_ns"),
            (ts + 500_000_000).alias("end_ns"),
            F.when(
                F.col("o_custkey") % 4 == 0, F.concat(F.lit("ext"), F.col("o_custkey") % 3)
            ).alias("peer"),
        )

    @cached_property
    def servers_src(self) -> DataFrame:
        key = F.col("l_orderkey")
        ts = (_days("l_shipdate") * 60 + key % 60 + F.col("l_linenumber")) * F.lit(SECOND)
        return self.table("lineitem").select(
            _hex(key + 1, 32).alias("trace_id"),
            _hex(key * 8 + F.col("l_linenumber"), 16, "f").alias("span_id"),
            _hex(key + 1, 16).alias("parent_span_id"),
            F.concat(F.lit("svc"), F.col("l_suppkey") % 5).alias("service_name"),
            F.when(F.col("l_returnflag") == "N", "SPAN_KIND_INTERNAL")
            .otherwise("SPAN_KIND_SERVER")
            .alias("span_kind"),
            F.when(F.col("l_linestatus") == "F", "STATUS_CODE_ERROR")
            .otherwise("STATUS_CODE_UNSET")
            .alias("status_code"),
            F.concat(F.lit("op"), F.col("l_partkey") % 7).alias("span_name"),
            ts.alias("ts_ns"),
            (ts + F.col("l_quantity").cast("bigint") * 1_000_000).alias("end_ns"),
            F.lit(None).cast("string").alias("peer"),
        )

    @cached_property
    def spans(self) -> DataFrame:
        return self.clients_src.unionByName(self.servers_src)

    @cached_property
    def events(self) -> DataFrame:
        """Events with the time in microseconds and the JSON payload's number."""
        return self.table("events").select(
            "event_id",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            "user_id",
            "event_type",
            "value",
            "props",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        start = W.floor_div("ts_us", 3_600_000_000) * 3600
        k = F.col("k")
        return self.events.select(
            start.alias("window_start"),
            (start + 3600).alias("window_end"),
            W.floor_div("ts_us", 1_000_000).alias("observed_at"),
            F.lit("service").alias("src_type"),
            F.concat(F.lit("svc"), F.col("user_id") % 9).alias("src_id"),
            F.when(k % 11 == 0, "database").otherwise("service").alias("dst_type"),
            F.concat(F.lit("svc"), k % 7).alias("dst_id"),
            F.when(F.col("event_type") == "signup", "runs_on").otherwise("calls").alias("rel_type"),
            F.when(F.col("event_type") == "click", "config").otherwise("trace").alias("provenance"),
            F.concat(F.lit("attr"), k % 2).alias("attributes"),
            F.when(k % 5 == 0, 0.5).otherwise(1.0).alias("confidence"),
            (k + 1).alias("request_count"),
            (k % 4).alias("unmatched_count"),
            (k % 3).alias("error_count"),
            F.col("value").alias("duration_sum"),
            (k + 1).alias("duration_count"),
            (F.col("value") / 2).alias("duration_max"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        start = W.floor_div("ts_us", 3_600_000_000) * 3600
        second = W.floor_div("ts_us", 1_000_000)
        return self.events.select(
            start.alias("window_start"),
            (start + 3600).alias("window_end"),
            F.col("event_type").alias("entity_type"),
            F.concat(F.lit("e"), F.col("user_id") % 40).alias("entity_id"),
            F.lit("id").alias("entity_id_attrs"),
            F.when(
                F.col("user_id") % 3 == 0, F.concat(F.lit("ns"), F.col("user_id") % 2)
            ).alias("scope"),
            F.concat(F.lit("v"), F.col("k") % 2).alias("descriptive"),
            F.concat(F.lit("metrics_"), "event_type").alias("source_tables"),
            second.alias("observed_at"),
            (second + 600).alias("fresh_until"),
        )

    @cached_property
    def points(self) -> DataFrame:
        user = F.col("user_id")
        return self.events.select(
            F.col("event_type").alias("metric"),
            (F.col("ts_us") * 1000).alias("ts_ns"),
            W.floor_div("ts_us", 1_000_000).alias("ts_s"),
            "value",
            F.col("event_id").alias("src_order"),
            F.concat(F.lit("c"), user % 20).alias("container"),
            F.concat(F.lit("p"), user % 20).alias("pod"),
            F.concat(F.lit("d"), user % 10).alias("deployment"),
            F.concat(F.lit("svc"), user % 5).alias("service_name"),
            F.concat(F.lit("ns"), user % 2).alias("namespace"),
            "user_id",
            "k",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.points.select(
            "metric",
            (W.floor_div("ts_s", 3600) * 3_600_000).alias("ts_ms"),
            "container",
            "value",
            "src_order",
            "k",
        )

    @cached_property
    def node_telemetry(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("case_id"),
            F.col("l_returnflag").alias("metric"),
            F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("node"),
            _days("l_shipdate").alias("ts"),
            F.col("l_quantity").alias("value"),
        )

    @cached_property
    def node_cases(self) -> DataFrame:
        key = F.col("s_suppkey")
        metrics = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
        return self.table("supplier").select(
            key.alias("case_id"),
            F.get(metrics, (key % 3).cast("int")).alias("metric"),
            F.concat(F.lit("n"), F.col("s_nationkey") % 5).alias("node"),
            F.lit(49.0).alias("threshold"),
            (F.lit(10000) + key % 10 * 100).cast("bigint").alias("alert"),
            (F.lit(10300) + key % 10 * 100).cast("bigint").alias("window_end"),
        )

    @cached_property
    def submitted(self) -> DataFrame:
        case, line, q = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity")
        grouped = self.table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(
            F.count(F.lit(1)).alias("n"),
            (F.min(q) / 1024).alias("lo"),
            (F.max(q) / 1024).alias("hi"),
            (F.sum(q) / F.count(F.lit(1)) / 1024).alias("mean"),
        )
        return grouped.select(
            case.alias("case_id"),
            line.alias("part"),
            F.when(line <= 3, "normal")
            .when((line == 4) & (case % 5 == 0), F.lit(None))
            .otherwise("abnormal")
            .alias("period"),
            "n",
            F.when(case % 3 != 0, F.col("lo")).alias("lo"),
            F.when(case % 7 != 0, F.col("hi")).alias("hi"),
            F.when(case % 4 != 0, F.col("mean")).alias("mean"),
            F.lit(1024.0).alias("scale"),
            F.when(case % 2 == 0, 48.0).otherwise(50.5).alias("threshold"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        flag = F.col("l_returnflag")
        grouped = self.table("lineitem").groupBy(
            F.concat(F.lit("m"), F.col("l_partkey") % 4).alias("model"),
            F.col("l_suppkey").alias("case_id"),
            F.col("l_linenumber").alias("repetition"),
            F.when(flag == "A", "split").when(flag == "N", "raw").otherwise("graph").alias(
                "treatment"
            ),
        ).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").cast("bigint").alias("q"),
            F.sum("l_orderkey").alias("s"),
            F.sum("l_partkey").alias("p"),
        )
        n, q, s, p = (F.col(c) for c in "nqsp")
        correct = (s % 10 > 0) & (s % 9 > 0) & (s % 7 > 0) & (p % 8 > 0)
        key = ["model", "case_id", "repetition", "treatment"]
        return grouped.select(
            *key,
            F.concat_ws("/", *[F.col(c).cast("string") for c in key]).alias("run_id"),
            n.alias("tool_calls"),
            F.when(p % 17 > 0, q).alias("rows_returned"),
            F.when(s % 19 > 0, s).alias("input_tokens"),
            p.alias("output_tokens"),
            F.when((F.col("model") != "m2") | (p % 5 > 0), p / 1000.0).alias("cost"),
            F.when(F.col("model") == "m3", "CNY").otherwise("USD").alias("currency"),
            (s % 10 > 0).alias("causal_scope_match"),
            (s % 9 > 0).alias("causal_locus_match"),
            (s % 7 > 0).alias("fault_category_match"),
            (p % 8 > 0).alias("mechanism_code_match"),
            (n % 5).alias("valid_evidence_count"),
            (n % 5 + s % 2).alias("cited_evidence_count"),
            (s % 23 == 0).alias("runner_error"),
            (s % 29 == 0).alias("tool_budget_exhausted"),
            (s % 6).alias("failed_queries"),
            (s % 4).alias("rejected_calls"),
            F.when(F.col("treatment") != "split", p % 2 == 0).alias("required_evidence_covered"),
            correct.alias("diagnosis_correct"),
            (correct & (n % 5 > 0) & (s % 23 > 0) & (s % 29 > 0)).alias("eligible"),
            ((n % 5 > 0) & (s % 2 == 0)).alias("citations_execution_valid"),
            (s % 11 > 0).alias("typed_evidence"),
        )

    @cached_property
    def case_table(self) -> DataFrame:
        key = F.col("s_suppkey")
        scopes = F.array(
            F.lit("component"), F.lit("dependency_edge"), F.lit("infrastructure_node")
        )
        return self.table("supplier").select(
            key.alias("case_id"),
            F.concat(F.lit("d"), F.col("s_nationkey") % 3).alias("dataset"),
            F.get(scopes, (key % 3).cast("int")).alias("causal_scope"),
            F.concat(F.lit("mech"), key % 6).alias("mechanism_code"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        k, kind, at = F.col("k"), F.col("event_type"), F.col("event_id")
        query_id = F.concat(F.lit("q"), k)
        none = F.array().cast("array<string>")
        return self.events.select(
            F.col("user_id").alias("run_id"),
            at.alias("ordinal"),
            query_id.alias("query_id"),
            F.when(kind == "view", "execute_sql")
            .when(kind == "click", "query_metrics")
            .when(kind == "error", "query_logs")
            .when(kind == "signup", "describe_table")
            .otherwise("query_semantic_graph")
            .alias("tool_name"),
            F.when(k % 2 == 0, "query_range").otherwise("labels").alias("operation"),
            (k % 9 == 0).alias("failed"),
            F.when(at % 13 == 0, "other").otherwise(query_id).alias("result_query_id"),
            (at % 11 == 0).alias("truncated"),
            F.when(k % 8 == 0, none)
            .when(k % 3 == 0, F.array(F.lit("logs")))
            .when(k % 3 == 1, F.array(F.lit("logs"), F.lit("Traces")))
            .otherwise(F.array(F.lit("cpu")))
            .alias("base_tables"),
            F.when(at % 17 > 0, F.floor("value").cast("bigint")).alias("rows_returned"),
            F.when(k % 4 == 0, "SELECT * FROM a JOIN b")
            .when(k % 4 == 1, "show tables")
            .when(k % 4 == 2, "SELECT 1 FROM information_schema.tables")
            .otherwise("SELECT joined FROM x")
            .alias("sql_text"),
            F.when(F.col("user_id") % 3 == 0, "split")
            .when(F.col("user_id") % 3 == 1, "raw")
            .otherwise("graph")
            .alias("treatment"),
            W.floor_div("ts_us", 1_000_000).alias("started"),
            (F.floor("value").cast("bigint") * 60).alias("elapsed"),
        )

    @cached_property
    def citations(self) -> DataFrame:
        doc = F.col("doc_id")
        locus, mechanism = F.lit("causal_locus"), F.lit("fault_mechanism")
        return self.table("documents").select(
            (doc % 150).alias("run_id"),
            doc.alias("ordinal"),
            F.concat(F.lit("q"), F.col("n_chars") % 100).alias("query_id"),
            F.when(doc % 10 == 0, "   ").otherwise(F.col("text")).alias("claim"),
            F.when(doc % 8 == 3, F.array(locus, locus))
            .when(doc % 8 == 7, F.array().cast("array<string>"))
            .when(doc % 8 == 1, F.array(locus, mechanism))
            .when(doc % 8 == 2, F.array(locus))
            .otherwise(F.array(mechanism))
            .alias("claim_types"),
        )
