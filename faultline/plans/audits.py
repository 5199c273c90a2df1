"""Fidelity audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators import audit as A
from faultline.operators import callgraph as G
from faultline.operators import collapse as C
from faultline.operators import surface as S
from faultline.plans.normalization import STORED, record_labels, stored_copy
from faultline.plans.registry import query
from faultline.plans.views import SECOND, WINDOW
from faultline.session import work_dir
from faultline.sources import sinks

SPANS = "clients_src servers_src spans"
# A whole minute, so that binned and raw edges split at the same place.
SPLIT = 619_980


@query(
    "f13_table_stats",
    "points",
    """SELECT metric, count(*) AS row_count, min(ts_ns) AS min_time, max(ts_ns) AS max_time
       FROM points GROUP BY metric""",
)
def table_stats(t):
    return A.table_stats(t.points, "metric", "ts_ns")


DIMENSIONS = ["service_name", "span_kind", "status_code"]
GROUP_COUNTS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS row_count FROM spans GROUP BY {d}"
    for d in DIMENSIONS
)


@query("f14_group_counts", SPANS, GROUP_COUNTS)
def group_counts(t):
    return A.group_counts(t.spans, DIMENSIONS)


@query(
    "f15_trace_identity",
    SPANS,
    """, g AS (SELECT count(*) AS n FROM spans GROUP BY trace_id, span_id),
       a AS (SELECT sum(n)::BIGINT AS spans, max(n) = 1 AS span_identity_unique FROM g),
       b AS (SELECT 'as it is' AS copy, 0 AS invalid_spans UNION ALL SELECT 'broken', count(*) FROM spans
             WHERE status_code = 'STATUS_CODE_ERROR' AND service_name = 'svc1')
       SELECT copy, spans, span_identity_unique, invalid_spans,
         span_identity_unique AND invalid_spans = 0 AS valid FROM a, b
       UNION ALL SELECT 'doubled', 2 * spans, false, 0, false FROM a""",
)
def trace_identity(t):
    # Failed spans of one service carry a kind outside of the protocol.
    broken = (F.col("status_code") == "STATUS_CODE_ERROR") & (F.col("service_name") == "svc1")
    named = ["trace_id", "span_id", "parent_span_id", "service_name"]
    sound = t.spans.select(*named, F.lit(2).alias("kind"), F.lit(0).alias("status"))
    wrong = t.spans.select(*named, F.when(broken, 9).otherwise(2).alias("kind"), F.lit(0).alias("status"))
    copies = {"as it is": sound, "broken": wrong, "doubled": sound.unionByName(sound)}
    # Copies as columns of one pass took longer: every row went through the shuffle four times.
    checked = [A.trace_identity(rows).withColumn("copy", F.lit(name)) for name, rows in copies.items()]
    return checked[0].unionByName(checked[1]).unionByName(checked[2])


@query(
    "f16_signal_periods",
    "points",
    """, r AS (SELECT metric, CASE WHEN metric = 'view' THEN greatest(ts_s, 1704153600)
                 WHEN k = 4 THEN NULL WHEN k = 5 THEN 1706659200 ELSE ts_s END AS s FROM points)
       SELECT metric, count(*) AS source_rows,
         count(CASE WHEN s < 1704153600 THEN 1 END) AS rows_before_start,
         count(CASE WHEN s = 1706659200 THEN 1 END) AS rows_at_exact_end,
         count(CASE WHEN s > 1706659200 THEN 1 END) AS rows_after_end,
         count(*) - count(s) AS null_timestamps,
         coalesce(bool_and(coalesce(s >= 1704153600 AND s < 1706659200, false)), false)
           AS all_rows_in_declared_window
       FROM r GROUP BY metric""",
)
def signal_periods(t):
    k = F.col("k")
    # One metric is moved into its window as a whole.
    ts = (
        F.when(F.col("metric") == "view", F.greatest(F.col("ts_s"), F.lit(1704153600)))
        .when(k == 4, F.lit(None)).when(k == 5, 1706659200).otherwise(F.col("ts_s"))
    )
    return A.signal_periods(
        t.points.withColumn("s", ts), ["metric"], "s", 1704153600, 1706659200
    )


@query(
    "f17_observed_window",
    "points",
    """SELECT container, min(ts_s) AS minimum, max(ts_s) AS maximum,
         min(ts_s) >= 1704070800 AND max(ts_s) < 1706655600 AS in_window
       FROM points GROUP BY container""",
)
def observed_window(t):
    return A.observed_window(t.points, ["container"], "ts_s", 1704070800, 1706655600)


@query(
    "f18_window_rows",
    "points",
    """SELECT metric AS file, count(*) AS source_rows,
         count(CASE WHEN ts_s BETWEEN 1704412800 AND 1705276800 THEN 1 END) AS window_rows
       FROM points GROUP BY metric""",
)
def window_rows(t):
    fine = F.col("metric").isin("view", "click")
    scale = F.when(fine, F.lit(1000)).otherwise(F.lit(1)).cast("bigint")
    rows = t.points.select(F.col("metric").alias("file"), (F.col("ts_s") * scale).alias("stamp"))
    scale = F.when(F.col("file").isin("view", "click"), F.lit(1000)).otherwise(F.lit(1))
    return A.window_rows(rows, "file", "stamp", 1704412800, 1705276800, scale.cast("bigint"))


@query(
    "f19_metric_stream",
    "points samples",
    """, r AS (SELECT metric, container, ts_ms, ts_ms // 1000 AS s, k % 8 > 0 AS ok FROM samples)
       SELECT count(CASE WHEN s >= 1704412800 AND s < 1705276800 THEN 1 END) AS rows_in_window,
         count(CASE WHEN s >= 1704412800 AND s < 1705276800 AND NOT ok THEN 1 END) AS invalid_values,
         (SELECT count(*) FROM (SELECT DISTINCT metric, container, ts_ms FROM r
            WHERE ok AND s >= 1704412800 AND s < 1705276800)) AS unique_samples,
         count(CASE WHEN s = 1705276800 THEN 1 END) AS rows_at_exact_end,
         count(DISTINCT CASE WHEN ok AND s >= 1704412800 AND s < 1705276800 THEN metric END)
           AS metric_tables FROM r""",
)
def metric_stream(t):
    value = F.when(F.col("k") % 8 == 0, float("nan")).otherwise(F.col("value"))
    rows = t.samples.withColumn("value", value).withColumn(
        "s", W.floor_div("ts_ms", 1000)
    )
    return A.metric_stream(rows, ["container", "ts_ms"], "s", 1704412800, 1705276800)


def catalog(t):
    """Parts as catalog rows with semantic options and entity declarations."""
    k = F.col("p_partkey")
    scoped = F.to_json(
        F.array(
            F.struct(F.lit("service").alias("entity"), F.col("p_brand").alias("scope")),
            F.struct(F.lit("host").alias("entity"), F.lit("").alias("scope")),
        )
    )
    plain = F.to_json(F.array(F.struct(F.lit("service").alias("entity"))))
    options = F.to_json(F.struct(F.col("p_name").alias("help"), F.lit("disk I/O w time").alias("unit")))
    return t.table("part").select(
        F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), k).alias("table_name"),
        F.when(k % 3 == 0, "metric").when(k % 3 == 1, "log").otherwise("trace").alias("signal_type"),
        F.col("p_type").alias("source"),
        F.when(k % 5 == 0, options).alias("semantic_options"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, scoped).otherwise(plain).alias(
            "entity_declarations"
        ),
        "p_partkey", "p_brand",
    )


CATALOG = """cat AS (SELECT lower(replace(p_name, ' ', '_')) || '_' || p_partkey AS table_name,
  CASE p_partkey % 3 WHEN 0 THEN 'metric' WHEN 1 THEN 'log' ELSE 'trace' END AS signal_type,
  p_type AS source,
  CASE WHEN p_partkey % 5 = 0 THEN '{"help":"' || p_name || '","unit":"disk I/O w time"}' END
    AS semantic_options,
  CASE p_partkey % 4 WHEN 0 THEN NULL
    WHEN 1 THEN '[{"entity":"service","scope":"' || p_brand || '"},{"entity":"host","scope":""}]'
    ELSE '[{"entity":"service"}]' END AS entity_declarations, p_partkey FROM part)"""


@query(
    "f84_scope_declarations",
    "",
    """SELECT source, count(CASE WHEN n % 4 = 1 THEN 1 END) AS scope_declaration_count
       FROM (SELECT p_type AS source, p_partkey AS n FROM part) GROUP BY source""",
)
def scope_declarations(t):
    return A.scope_declarations(catalog(t), ["source"], "entity_declarations")


@query(
    "f84_malformed_declarations",
    "",
    """SELECT source, CASE WHEN count(CASE WHEN n % 28 = 1 THEN 1 END) = 0
         THEN count(CASE WHEN n % 4 = 1 THEN 1 END) END AS scope_declaration_count
       FROM (SELECT 'b' || (p_partkey % 91) AS source, p_partkey AS n FROM part) GROUP BY source""",
)
def malformed(t):
    broken = F.when(F.col("p_partkey") % 28 == 1, "[{broken").otherwise(
        F.col("entity_declarations")
    )
    rows = catalog(t).withColumns(
        {
            "entity_declarations": broken,
            "source": F.concat(F.lit("b"), F.col("p_partkey") % 91),
        }
    )
    return A.scope_declarations(rows, ["source"], "entity_declarations")


@query(
    "f85_declared_services",
    SPANS,
    """SELECT count(CASE WHEN service_name IN ('', 'unknown') OR service_name IS NULL THEN 1 END) = 0
         AS service_names_declared FROM spans""",
)
def declared(t):
    return A.declared_services(t.spans, "service_name")


@query(
    "f86_first_alert",
    "points",
    "SELECT container, min(ts_s) AS first_alert FROM points WHERE metric = 'error' GROUP BY container",
)
def first_alert(t):
    return A.first_alert(t.points.where(F.col("metric") == "error"), "container", "ts_s")


@query(
    "f86_fault_taxonomy",
    "",
    """SELECT DISTINCT c_nationkey % 3 AS system, c_mktsegment AS kind FROM customer
       WHERE c_custkey % 7 <> 0""",
)
def taxonomy(t):
    rows = t.table("customer").select(
        (F.col("c_nationkey") % 3).alias("system"), F.col("c_mktsegment").alias("kind"),
        (F.col("c_custkey") % 7 == 0).alias("hybrid"),
    )
    return A.fault_taxonomy(rows, "system", "kind")


@query(
    "f86_alert_text",
    "points",
    """SELECT container, service_name,
         service_name || ' alert: ' || string_agg(issue, ', ' ORDER BY issue) AS alert_text
       FROM (SELECT DISTINCT container, service_name, metric || '-' || (k % 3) AS issue FROM points
             UNION SELECT container, service_name, 'any' FROM points)
       GROUP BY container, service_name""",
)
def alert_text(t):
    issue = F.to_json(
        F.map_from_arrays(
            F.array(F.concat_ws("-", "metric", (F.col("k") % 3).cast("string")), F.lit("any")),
            F.array(F.lit(1), F.lit(2)),
        )
    )
    rows = t.points.select("container", "service_name", issue.alias("issues"))
    return A.alert_text(rows, "container", "service_name", "issues")


@query(
    "f87_topology_size",
    "",
    """SELECT (SELECT count(*) FROM customer) AS entities, count(*) AS edges,
         count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS calls FROM orders""",
)
def topology_size(t):
    edges = t.table("orders").select(
        F.when(F.col("o_orderstatus") == "F", "runs_on").otherwise("calls").alias("relation")
    )
    return A.topology_size(t.table("customer"), edges)


COPIES = f"""WITH {STORED}, a AS (SELECT trace, line, flag, count(*) AS n FROM src GROUP BY ALL),
  b AS (SELECT trace, line, flag, count(*) AS n FROM stored GROUP BY ALL),
  j AS (SELECT coalesce(a.trace, b.trace) AS trace, coalesce(a.line, b.line) AS line,
          coalesce(a.flag, b.flag) AS flag, coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r
        FROM a FULL OUTER JOIN b ON a.trace = b.trace AND a.line = b.line AND a.flag = b.flag)"""
KEYS = ["trace", "line", "flag"]


@query(
    "i1_multiset_difference",
    "",
    f"""{COPIES} SELECT sum(l)::BIGINT AS source_rows, sum(r)::BIGINT AS stored_rows,
          sum(greatest(l - r, 0))::BIGINT AS missing_rows, sum(greatest(r - l, 0))::BIGINT AS extra_rows,
          sum(abs(l - r)) = 0 AS equal FROM j""",
)
def multiset(t):
    return A.multiset_difference(*stored_copy(t), KEYS)


@query(
    "i2_presence_difference",
    "",
    f"""{COPIES} SELECT sum(l)::BIGINT AS source_records, sum(r)::BIGINT AS stored_records,
          count(CASE WHEN l > 0 THEN 1 END) AS distinct_source_records,
          count(CASE WHEN l > 0 AND r = 0 THEN 1 END) AS missing_records,
          sum(greatest(r - l, 0))::BIGINT AS extra_records,
          (sum(l) - count(CASE WHEN l > 0 THEN 1 END))::BIGINT AS source_duplicate_records,
          sum(greatest(r - l, 0)) = 0 AND count(CASE WHEN l > 0 AND r = 0 THEN 1 END) = 0 AS equal FROM j
        UNION ALL SELECT sum(l)::BIGINT, count(CASE WHEN l > 0 THEN 1 END), count(CASE WHEN l > 0 THEN 1 END),
          0, 0, (sum(l) - count(CASE WHEN l > 0 THEN 1 END))::BIGINT, true FROM j""",
)
def presence(t):
    source, stored = stored_copy(t)
    # A store that keeps one of identical records still has them all.
    collapsed = A.presence_difference(source, source.select(*KEYS).distinct(), KEYS)
    return A.presence_difference(source, stored, KEYS).unionByName(collapsed)


@query(
    "i2_difference_examples",
    "",
    f"""{COPIES} (SELECT 'missing' AS kind, trace, line, flag FROM j WHERE l > 0 AND r = 0
          ORDER BY trace, line, flag LIMIT 3) UNION ALL
        (SELECT 'extra', trace, line, flag FROM j WHERE r > l ORDER BY trace, line, flag LIMIT 3)""",
)
def examples(t):
    return A.difference_examples(*stored_copy(t), KEYS)


RAW_EDGES = """e AS (SELECT src_id, dst_id, count(*) AS n,
  CASE WHEN client_ns < 619980 * 1000000000::BIGINT THEN 'normal' ELSE 'abnormal' END AS period
  FROM pairs WHERE src_id <> dst_id GROUP BY ALL)"""


def raw_and_graph(t):
    """Edges derived from raw pairs and from the minute bins of the graph, per period."""
    pairs = G.span_pairs(t.spans, WINDOW).withColumn(
        "period", W.period_by_boundary("client_ns", SPLIT * SECOND)
    )
    raw = pairs.groupBy("period", "src_id", "dst_id").agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if("error").alias("error_count")
    )
    identity = [
        F.lit("service").alias("src_type"), "src_id", F.lit("service").alias("dst_type"), "dst_id",
        F.lit("calls").alias("rel_type"), F.lit("trace").alias("provenance"),
    ]
    raw = raw.select("period", *identity, "request_count", "error_count")
    bins = G.edge_observations(t.spans, WINDOW, peer="peer").withColumn(
        "period", W.period_by_boundary("window_start", SPLIT)
    )
    graph = (
        bins.where((F.col("confidence") == 1.0) & (F.col("dst_type") == "service"))
        .groupBy("period", *G.EDGE)
        .agg(F.sum("request_count").alias("request_count"), F.sum("error_count").alias("error_count"))
    )
    return raw, graph


@query(
    "i3_edge_sets_equal",
    f"{SPANS} pairs",
    """, n AS (SELECT count(DISTINCT (src_id, dst_id)) AS n FROM pairs WHERE src_id <> dst_id)
       SELECT 'whole' AS graph, n AS left_edges, n AS right_edges, true AS exact FROM n
       UNION ALL SELECT 'truncated', n, n, NULL FROM n""",
)
def edge_sets(t):
    left = G.call_edges(G.span_pairs(t.spans, WINDOW))
    right = G.paired_edges(G.edge_observations(t.spans, WINDOW, peer="peer"))
    whole = A.edge_sets_equal(left, right).withColumn("graph", F.lit("whole"))
    cut = A.edge_sets_equal(left, right, right_truncated=True).withColumn("graph", F.lit("truncated"))
    return whole.unionByName(cut)


@query(
    "i3_edge_sets_differ",
    f"{SPANS} pairs",
    """SELECT src_id, count(DISTINCT CASE WHEN src_id <> dst_id THEN dst_id END) AS left_edges,
         count(DISTINCT dst_id) AS right_edges,
         CASE WHEN count(CASE WHEN src_id = dst_id THEN 1 END) = 0 THEN true ELSE false END AS exact
       FROM pairs GROUP BY src_id""",
)
def edge_sets_differ(t):
    pairs = G.span_pairs(t.spans, WINDOW, exclude_self=False)
    every = G.call_edges(pairs)
    named = [c for c in G.EDGE if c != "src_id"]
    distinct = every.where(F.col("src_id") != F.col("dst_id"))
    # Compared per caller: the caller is both a key and a part of the identity.
    return A.edge_sets_equal(
        distinct.withColumn("caller", F.col("src_id")).select(
            "caller", "src_id", *named, "request_count", "error_count"
        ),
        every.withColumn("caller", F.col("src_id")).select(
            "caller", "src_id", *named, "request_count", "error_count"
        ),
        ["caller"],
    ).withColumnRenamed("caller", "src_id")


@query(
    "i4_period_edges_equal",
    f"{SPANS} pairs",
    f""", {RAW_EDGES} SELECT period, count(*) AS left_edges,
          count(CASE WHEN period = 'normal' OR src_id <> 'svc3' THEN 1 END) AS right_edges,
          count(CASE WHEN period = 'abnormal' AND src_id = 'svc3' THEN 1 END) = 0 AS exact
        FROM e GROUP BY period""",
)
def period_edges(t):
    raw, graph = raw_and_graph(t)
    # The graph misses one caller of the incident.
    return A.edge_sets_equal(
        raw, graph.where((F.col("period") == "normal") | (F.col("src_id") != "svc3")), ["period"])


@query(
    "i5_unexpected_tables",
    "",
    """WITH s AS (SELECT replace(p_name, ' ', '_') || CASE p_partkey % 5 WHEN 0 THEN '_sum'
           WHEN 1 THEN '_bucket' WHEN 2 THEN '_total' WHEN 3 THEN '' ELSE '_count' END AS table_name
         FROM part UNION ALL SELECT 'traces' UNION ALL SELECT 'labels'),
       e AS (SELECT replace(p_name, ' ', '_') AS table_name FROM part WHERE p_partkey % 2 = 0
         UNION SELECT replace(p_name, ' ', '_') || x FROM part,
           (VALUES ('_sum'), ('_count'), ('_bucket')) v(x) WHERE p_size > 25)
       SELECT DISTINCT table_name FROM s WHERE table_name <> 'traces'
         AND table_name NOT IN (SELECT table_name FROM e)""",
)
def unexpected(t):
    part = t.table("part")
    k = F.col("p_partkey") % 5
    suffix = (
        F.when(k == 0, "_sum").when(k == 1, "_bucket").when(k == 2, "_total").when(k == 3, "")
        .otherwise("_count")
    )
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    fixed = part.select(F.explode(F.array(F.lit("traces"), F.lit("labels"))).alias("table_name"))
    stored = part.select(F.concat(base, suffix).alias("table_name")).unionByName(fixed.distinct())
    numbers = part.where(F.col("p_partkey") % 2 == 0).select(F.col("p_name").alias("metric"))
    histograms = part.where(F.col("p_size") > 25).select(F.col("p_name").alias("metric"))
    return A.unexpected_tables(stored, numbers, histograms, ["traces", "logs", "events", "alerts"])


@query(
    "i6_reachability",
    "",
    """WITH r AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click' AND value > 200),
       e AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 10 <> 3),
       c AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 4 = 0)
       SELECT count(*) AS returned,
         count(CASE WHEN id IN (SELECT id FROM c) THEN 1 END) AS returned_causal,
         count(CASE WHEN id NOT IN (SELECT id FROM e) THEN 1 END) AS returned_outside,
         count(CASE WHEN id IN (SELECT id FROM c) THEN 1 END) > 0
           AND count(CASE WHEN id NOT IN (SELECT id FROM e) THEN 1 END) = 0 AS reachable FROM r""",
)
def reachability(t):
    rows = t.table("events").withColumnRenamed("user_id", "id")
    returned = rows.where((F.col("event_type") == "click") & (F.col("value") > 200))
    return A.reachability(
        returned, rows.where(F.col("id") % 10 != 3), rows.where(F.col("id") % 4 == 0), "id"
    )


@query(
    "i7_generated_labels",
    "",
    """SELECT 'log_table' AS label, count(*) AS entries FROM documents
       UNION ALL SELECT 'detected_level', count(*) FROM documents WHERE n_chars % 2 = 0""",
)
def generated(t):
    docs = t.table("documents")
    extra = F.when(
        F.col("n_chars") % 2 == 0, F.create_map(F.lit("detected_level"), F.lit("info"))
    ).otherwise(F.expr("cast(map() as map<string,string>)"))
    stored = docs.select(
        F.map_concat(N.stream_labels(record_labels(), F.lit("logs")), extra).alias("labels")
    )
    source = docs.select(record_labels().alias("labels"))
    return A.generated_labels(stored, source, "labels")


@query(
    "i7_foreign_streams",
    "",
    """SELECT source AS asked, count(CASE WHEN doc_id % 13 = 0 THEN 1 END)
         AS streams_from_another_table FROM documents GROUP BY source""",
)
def foreign(t):
    rows = t.table("documents").select(F.col("source").alias("asked"), "doc_id")
    carrier = F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("asked"))
    return A.foreign_streams(rows.withColumn("carrier", carrier), "asked", F.col("carrier"))


@query(
    "i8_dataset_digest",
    "",
    r"""SELECT count(*) AS rows, sum(('0x' || substr(sha256(
          l_orderkey || chr(31) || l_linenumber || chr(31) || l_returnflag || chr(31)
          || round(l_extendedprice * 100)::BIGINT), 1, 15))::BIGINT)::VARCHAR AS digest FROM lineitem""",
)
def digest(t):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    columns = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), cents]
    return A.dataset_digest(t.table("lineitem"), columns)


@query(
    "i9_union_of_sources",
    "points",
    """SELECT kind, count(*) AS rows, count(le) AS bounded FROM (
         SELECT 'gauge' AS kind, NULL AS le FROM points WHERE k % 2 = 0
         UNION ALL SELECT 'sum', NULL FROM points WHERE k % 2 = 1
         UNION ALL SELECT 'histogram', 'inf' FROM points WHERE k % 3 = 0) GROUP BY kind""",
)
def union(t):
    k = F.col("k")
    gauges = t.points.where(k % 2 == 0).withColumn("kind", F.lit("gauge"))
    sums = t.points.where(k % 2 == 1).withColumn("kind", F.lit("sum"))
    histograms = t.points.where(k % 3 == 0).withColumns(
        {"kind": F.lit("histogram"), "le": F.lit("inf")}
    )
    rows = C.union_sources(gauges, sums, histograms)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count("le").alias("bounded"))


@query(
    "i10_gate_table",
    f"{SPANS} pairs",
    """, ed AS (SELECT src_id, dst_id, count(*) AS n FROM pairs WHERE src_id <> dst_id GROUP BY ALL),
       mi AS (SELECT src_id, dst_id, sum(n) AS n FROM (SELECT client_ns // 60000000000 AS m, src_id, dst_id,
                count(*) AS n FROM pairs WHERE src_id <> dst_id GROUP BY ALL) GROUP BY src_id, dst_id),
       g AS (SELECT 'spans_unique' AS gate, count(*) = count(DISTINCT (trace_id, span_id)) AS passed FROM spans
             UNION ALL SELECT 'edges_exact', count(*) = count(CASE WHEN ed.n = mi.n THEN 1 END)
               FROM ed FULL OUTER JOIN mi ON ed.src_id = mi.src_id AND ed.dst_id = mi.dst_id
             UNION ALL SELECT 'service_names_declared',
               count(*) = count(CASE WHEN service_name NOT IN ('', 'unknown') THEN 1 END) FROM spans)
       SELECT * FROM g UNION ALL SELECT 'all_passed', bool_and(passed) FROM g""",
)
def gates(t):
    coded = t.spans.withColumns({"kind": F.lit(2), "status": F.lit(0)})
    left = G.call_edges(G.span_pairs(t.spans, WINDOW))
    right = G.paired_edges(G.edge_observations(t.spans, WINDOW, peer="peer"))
    about_spans = A.span_gates(coded).where(F.col("gate").isin("spans_unique", "service_names_declared"))
    return A.gate_table({"edges_exact": A.edge_sets_equal(left, right).select("exact")}, [about_spans])


@query(
    "i13_count_agreement",
    SPANS,
    f""", src AS ({GROUP_COUNTS})
        SELECT dimension, value, row_count AS expected_rows,
          CASE WHEN value = 'svc2' THEN 0 ELSE row_count END AS stored_rows,
          value <> 'svc2' AS match FROM src""",
)
def agreement(t):
    expected = A.group_counts(t.spans, DIMENSIONS)
    stored = expected.where(F.col("value") != "svc2")
    return A.count_agreement(expected, stored, ["dimension", "value"])


# What the stored copy has wrong, by user: samples lost, another label value, times moved by one
# millisecond, all lost, nothing.
@query(
    "i14_surface_check",
    "points",
    """, src AS (SELECT metric || '_' || (user_id % 30) AS metric, user_id % 30 % 5 AS u, container,
                  ts_ns // 1000000 AS ms, k FROM points),
       st AS (SELECT metric, CASE WHEN u = 1 AND k = 3 THEN 'x-' || container ELSE container END AS container,
                CASE WHEN u = 2 THEN ms + 1 ELSE ms END AS ms FROM src
              WHERE u <> 3 AND NOT (u = 0 AND k % 3 = 0)),
       two AS (SELECT * FROM (SELECT metric, container, ms, true AS own FROM src
                 UNION ALL SELECT metric, container, ms, false FROM st)
               WHERE ms >= 1704412800000 AND ms < 1705276800000),
       pr AS (SELECT metric, min(ms) + 1000 AS e FROM src
              WHERE ms >= 1704412800000 AND ms + 1000 < 1705276800000 GROUP BY metric),
       sides AS (SELECT metric, container, bool_or(own) AND bool_or(NOT own) AS same FROM two GROUP BY ALL),
       se AS (SELECT metric, bool_and(same) AS same FROM sides GROUP BY metric),
       la AS (SELECT metric, bool_or(own) AND bool_or(NOT own) AS same FROM two GROUP BY metric),
       ti AS (SELECT metric, container, max(ms) FILTER (own) AS s, max(ms) FILTER (NOT own) AS t
              FROM two JOIN pr USING (metric) WHERE ms <= e AND ms > e - 300000 GROUP BY ALL),
       i AS (SELECT metric, bool_and(coalesce(abs(s - t) <= 2, false)) AS same FROM ti GROUP BY metric),
       g AS (SELECT unnest(range(1704412800000, 1705276800000, 3600000)) AS e),
       tr AS (SELECT metric, container, e, max(ms) FILTER (own) AS s, max(ms) FILTER (NOT own) AS t
              FROM two JOIN g ON ms <= e AND ms > e - 300000 GROUP BY ALL),
       r AS (SELECT metric, bool_and(coalesce(abs(s - t) <= 2, false)) AS same FROM tr GROUP BY metric)
       SELECT pr.metric, la.same AS labels_pass, se.same AS values_pass, se.same AS series_pass,
         coalesce(i.same, false) AS instant_pass, coalesce(r.same, se.same) AS range_pass
       FROM pr JOIN la USING (metric) JOIN se USING (metric) LEFT JOIN i USING (metric)
         LEFT JOIN r USING (metric)""",
)
def surface(t):
    rows = t.points.select(
        F.concat_ws("_", "metric", (F.col("user_id") % 30).cast("string")).alias("metric"),
        (F.col("user_id") % 30 % 5).alias("u"),
        "container",
        W.floor_div("ts_ns", 1_000_000).alias("ts_ms"),
        "k",
    )
    u, k = F.col("u"), F.col("k")
    other = F.when((u == 1) & (k == 3), F.concat(F.lit("x-"), "container")).otherwise(F.col("container"))
    stored = rows.where((u != 3) & ~((u == 0) & (k % 3 == 0))).select(
        "metric", other.alias("container"), (F.col("ts_ms") + F.when(u == 2, 1).otherwise(0)).alias("ts_ms"))

    def labelled_by_container(samples):
        return samples.withColumn("labels", F.create_map(F.lit("container"), "container"))

    return S.surface_check(
        labelled_by_container(rows), labelled_by_container(stored), (1704412800000, 1705276800000))


SIGNALS = """, src AS (SELECT 'metrics' AS signal, ts_ns FROM points UNION ALL SELECT 'traces', ts_ns FROM spans)"""


def stored_signals(t):
    """Two signals as canonical tables, and their statistics from file footers."""
    spark = t.spans.sparkSession
    path = work_dir(spark, "telemetry")
    sinks.write_telemetry(t.points, path, "metrics")
    sinks.write_telemetry(t.spans, path, "traces")
    return sinks.stored_stats(spark, path)


@query(
    "f13_stored_stats",
    f"points {SPANS}",
    f"""{SIGNALS} SELECT signal, count(*) AS row_count, min(ts_ns) AS min_time, max(ts_ns) AS max_time
        FROM src GROUP BY signal""",
)
def stored_stats(t):
    return stored_signals(t)


@query(
    "i13_stored_agreement",
    f"points {SPANS}",
    f"""{SIGNALS} SELECT signal, count(*) AS expected_rows, count(*) AS stored_rows, true AS match
        FROM src GROUP BY signal""",
)
def stored_agreement(t):
    sources = t.points.select(F.lit("metrics").alias("signal")).unionByName(t.spans.select(F.lit("traces").alias("signal")))
    expected = sources.groupBy("signal").agg(F.count(F.lit(1)).alias("row_count"))
    return A.count_agreement(expected, stored_signals(t), ["signal"])


# A copy with one changed record: digests tell the bucket, and only that bucket is opened.
@query(
    "i1_changed_records",
    "",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = k THEN 1 ELSE 0 END AS missing,
         0 AS extra FROM orders, (SELECT min(o_orderkey) AS k FROM orders) WHERE o_orderkey = k
       UNION ALL SELECT o_orderkey, -1, 0, 1 FROM orders, (SELECT min(o_orderkey) AS k FROM orders)
       WHERE o_orderkey = k""",
)
def changed_records(t):
    keys = ["o_orderkey", "o_custkey"]
    source = t.table("orders").select(*keys)
    first = source.agg(F.min("o_orderkey").alias("first"))
    stored = source.join(first, F.col("o_orderkey") == F.col("first"), "left").select(
        "o_orderkey", F.when(F.col("first").isNotNull(), F.lit(-1).cast(source.schema["o_custkey"].dataType)).otherwise(
            F.col("o_custkey")).alias("o_custkey"))
    spark = source.sparkSession
    paths = [work_dir(spark, name) for name in ("source", "stored")]
    for rows, path in zip((source, stored), paths):
        sinks.write_records(rows, path, keys, buckets=32)
    copies = A.record_copies(*sinks.changed_records(spark, *paths, keys), keys)
    gap = F.col("source_copies") - F.col("stored_copies")
    return copies.where(gap != 0).select(
        *keys, F.greatest(gap, F.lit(0)).cast("int").alias("missing"), F.greatest(-gap, F.lit(0)).cast("int").alias("extra"))
