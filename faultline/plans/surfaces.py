"""Query surface queries: graph, catalog, metric, log and trace access."""

from __future__ import annotations


from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators import surface as S
from faultline.operators.callgraph import EDGE, distinct_edges
from faultline.plans.audits import CATALOG, catalog
from faultline.plans.graph import EDGE_SQL, ENTITY_SQL, MAXES, RANGE
from faultline.plans.normalization import labelled, record_labels
from faultline.plans.registry import query
from faultline.plans.views import EVENTS_BOUNDARY, EVENTS_START, SECOND

ALLOWED = (EVENTS_START, EVENTS_BOUNDARY)


@query(
    "f12_catalog_groups",
    "",
    f"""WITH {CATALOG} SELECT signal_type, source, count(*) AS table_count FROM cat
        GROUP BY signal_type, source""",
)
def catalog_groups(t):
    return S.catalog_groups(catalog(t))


@query(
    "h1_limit_with_flag",
    "",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 200 AS truncated FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""",
)
def limited(t):
    rows = t.table("orders").select("o_orderkey", "o_totalprice")
    return S.limited(rows, [F.col("o_totalprice").desc(), "o_orderkey"], 200)


@query(
    "h1_limit_at_cap",
    "",
    "SELECT n_nationkey, n_name, false AS truncated FROM nation ORDER BY n_nationkey LIMIT 25",
)
def at_cap(t):
    return S.limited(t.table("nation").select("n_nationkey", "n_name"), ["n_nationkey"], 25)


HAYSTACK = r"""lower(regexp_replace(concat_ws(' ', table_name, semantic_options, entity_declarations),
  '\b([A-Za-z])\s*/\s*([A-Za-z])\b', '\1\2', 'g'))"""


def _matched(terms):
    """SQL list of the terms a catalog row matches."""
    parts = []
    for term in terms:
        hit = f"list_contains(tk, '{term}')"
        if term == "write":
            hit += " OR contains(' ' || array_to_string(tk, ' ') || ' ', ' io w ')"
        if len(term) > 2:
            hit += f" OR contains(hay, '{term}')"
        parts.append(f"CASE WHEN {hit} THEN '{term}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _found(terms, where="true"):
    named = " OR ".join(
        f"contains(lower({c}), '{term}')"
        for term in terms
        for c in ("table_name", "coalesce(semantic_options, '')", "coalesce(entity_declarations, '')")
    )
    return f"""{CATALOG}, h AS (SELECT *, {HAYSTACK} AS hay FROM cat WHERE ({named}) AND {where}),
  k AS (SELECT *, regexp_extract_all(hay, '[a-z0-9]+') AS tk FROM h),
  found AS (SELECT * FROM (SELECT *, {_matched(terms)} AS terms FROM k) WHERE len(terms) > 0)"""


# Fourteen words are left of these; all of them count.
TEXT = "the red widget for disk I/O write time in brushed_copper or small economy steel, promo nickel tin"
TERMS = [
    "red", "widget", "disk", "io", "write", "time", "brushed", "copper", "small", "economy", "steel",
    "promo", "nickel", "tin",
]


@query(
    "h2_catalog_search",
    "",
    f"""WITH {_found(TERMS)} SELECT table_name, array_to_string(terms, ',') AS matched FROM found""",
)
def search(t):
    return S.search_catalog(catalog(t), TEXT).select(
        "table_name", F.array_join("matched_terms", ",").alias("matched")
    )


@query(
    "l3_search_page",
    "",
    f"""WITH {_found(TERMS, "signal_type = 'metric'")}
        SELECT table_name, array_to_string(terms, ',') AS matched,
          (SELECT count(*) FROM found) > 20 AS truncated
        FROM found ORDER BY len(terms) DESC, lower(table_name), table_name LIMIT 20""",
)
def page(t):
    return S.search_page(catalog(t), TEXT, "metric", 20).select(
        "table_name", F.array_join("matched_terms", ",").alias("matched"), "truncated"
    )


@query(
    "h3_target_ranks",
    "",
    f"""WITH {_found(TERMS)}, r AS (SELECT table_name, row_number() OVER
          (ORDER BY len(terms) DESC, lower(table_name), table_name) AS target_rank FROM found)
        SELECT c.table_name, r.target_rank, coalesce(r.target_rank <= 5, false) AS in_top
        FROM cat c LEFT JOIN r ON c.table_name = r.table_name WHERE c.source = 'PROMO'""",
)
def target_ranks(t):
    rows = catalog(t)
    targets = rows.where(F.col("source") == "PROMO").select("table_name")
    return S.target_ranks(S.search_catalog(rows, TEXT), targets)


@query(
    "h4_causal_first_sample",
    "clients_src servers_src spans",
    """, c AS (SELECT DISTINCT trace_id FROM spans WHERE service_name = 'svc1'
               AND span_kind = 'SPAN_KIND_SERVER' AND span_name = 'op3'),
       a AS (SELECT DISTINCT trace_id FROM spans)
       SELECT a.trace_id, c.trace_id IS NOT NULL AS causal, (SELECT count(*) FROM a) > 25 AS truncated
       FROM a LEFT JOIN c ON a.trace_id = c.trace_id
       ORDER BY c.trace_id IS NOT NULL DESC, a.trace_id LIMIT 25""",
)
def sample(t):
    causal = t.spans.where(
        (F.col("service_name") == "svc1")
        & (F.col("span_kind") == "SPAN_KIND_SERVER")
        & (F.col("span_name") == "op3")
    )
    return S.causal_first_sample(t.spans, causal, 25)


@query(
    "h5_newest_rows",
    "points",
    """SELECT src_order, ts_ns, metric, (SELECT count(*) FROM points) > 50 AS truncated FROM points
       ORDER BY ts_ns DESC, src_order LIMIT 50""",
)
def newest(t):
    return S.newest(t.points.select("src_order", "ts_ns", "metric"), "ts_ns", 50, ["src_order"])


@query(
    "h7_ordered_edges",
    "observations",
    f"""SELECT row_number() OVER (ORDER BY {EDGE_SQL}) AS position, {EDGE_SQL}
        FROM (SELECT DISTINCT {EDGE_SQL} FROM observations)""",
)
def ordered(t):
    return S.ordered(distinct_edges(t.observations), EDGE)


@query(
    "l1_query_relationships",
    "observations",
    f""", w AS (SELECT window_start, window_end, {EDGE_SQL}, {MAXES} FROM observations
          WHERE {RANGE} AND rel_type = 'calls' AND provenance = 'trace'
          GROUP BY window_start, window_end, {EDGE_SQL}),
        r AS (SELECT {EDGE_SQL}, max(confidence) AS confidence,
          sum(request_count)::BIGINT AS request_count, sum(error_count)::BIGINT AS error_count
          FROM w GROUP BY {EDGE_SQL})
        SELECT *, (SELECT count(*) FROM r) > 50 AS truncated FROM r ORDER BY {EDGE_SQL} LIMIT 50""",
)
def relationships(t):
    return S.query_graph(
        t.entities, t.observations, "relationships", ALLOWED,
        {"rel_type": "calls", "provenance": "trace"}, limit=50,
    ).select(*EDGE_SQL.split(", "), "confidence", "request_count", "error_count", "truncated")


@query(
    "l1_query_entities",
    "entities",
    f""", r AS (SELECT window_start, window_end, {ENTITY_SQL}, max(fresh_until) AS fresh_until
          FROM entities WHERE observed_at >= 1704153600 AND observed_at < 1704240000
            AND entity_type = 'error'
          GROUP BY window_start, window_end, {ENTITY_SQL})
        SELECT *, (SELECT count(*) FROM r) > 5000 AS truncated FROM r
        ORDER BY window_start, window_end, {ENTITY_SQL.replace('scope', 'scope NULLS FIRST')} LIMIT 5000""",
)
def entity_view(t):
    return S.query_graph(
        t.entities, t.observations, "entities", ALLOWED, {"entity_type": "error"},
        1704153600, 1704240000, "window", 5000,
    )


@query(
    "l2_describe_nullability",
    "clients_src servers_src spans",
    """SELECT 0 AS ordinal, 'trace_id' AS name, false AS nullable, count(*) AS rows,
         count(*) - count(trace_id) AS nulls, NULL AS first_time FROM spans
       UNION ALL SELECT 1, 'peer', true, count(*), count(*) - count(peer), NULL FROM spans
       UNION ALL SELECT 2, 'ts_ns', true, count(*), count(*) - count(ts_ns), min(ts_ns)::VARCHAR FROM spans""",
)
def nullability(t):
    declared = {"trace_id": "no", "peer": "Y", "ts_ns": "1"}
    described = S.describe_table(t.spans.select(*declared), {"ts_ns": "timestamp"}, declared)
    return described.select("ordinal", "name", "nullable", "rows", "nulls", "first_time")


SAMPLES_MS = """s AS (SELECT metric, container, ts_ns // 1000000 AS ts_ms, value, src_order FROM points)"""


def samples_ms(t):
    return t.points.select(
        "metric", "container",
        W.floor_div("ts_ns", 1_000_000).alias("ts_ms"), "value", "src_order",
    )


@query(
    "e17_instant_select",
    "points",
    f""", {SAMPLES_MS} SELECT metric, container, 1705276800000::BIGINT AS eval_ms,
          max(ts_ms) AS sample_ms, arg_max(value, (ts_ms, src_order)) AS value FROM s
          WHERE ts_ms <= 1705276800000 AND ts_ms > 1705276800000 - 86400000
          GROUP BY metric, container""",
)
def instant(t):
    return S.metric_instant(
        samples_ms(t), ["metric", "container"], 1705276800000, 86_400_000, order=["src_order"]
    )


@query(
    "l4_metric_range",
    "points",
    f""", {SAMPLES_MS}, g AS (SELECT unnest(range(1704412800000, 1705276800001, 3600000)) AS eval_ms)
          SELECT metric, container, eval_ms, max(ts_ms) AS sample_ms,
            arg_max(value, (ts_ms, src_order)) AS value
          FROM g JOIN s ON ts_ms <= eval_ms AND ts_ms > eval_ms - 14400000
          GROUP BY metric, container, eval_ms""",
)
def metric_range(t):
    return S.metric_range(
        samples_ms(t), ["metric", "container"], 1704412800000, 1705276800000, 3_600_000,
        14_400_000, order=["src_order"],
    )


def log_records(t):
    return t.table("documents").select(
        "doc_id", (F.col("doc_id") * 60 * F.lit(SECOND)).alias("ts_ns"),
        F.col("text").alias("message"), N.drop_empty(record_labels()).alias("labels"),
    )


LOG_WHERE = """ts_ns >= 600 * 1000000000::BIGINT AND ts_ns < 1000000000000000000
  AND lang = 'en' AND source <> 'src3'"""
LOG_ROWS = """l AS (SELECT doc_id, doc_id * 60 * 1000000000::BIGINT AS ts_ns, text AS message, source,
  CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents)"""


@query(
    "l5_log_range_backward",
    "",
    f"""WITH {LOG_ROWS} SELECT doc_id, ts_ns, message,
          (SELECT count(*) FROM l WHERE {LOG_WHERE}) > 100 AS truncated
        FROM l WHERE {LOG_WHERE} ORDER BY ts_ns DESC, doc_id LIMIT 100""",
)
def logs_backward(t):
    return S.log_range(
        log_records(t), [("lang", "=", "en"), ("source.name", "!=", "src3")], 600 * SECOND,
        10**18, ties=["doc_id"],
    ).select("doc_id", "ts_ns", "message", "truncated")


@query(
    "l5_log_range_forward",
    "",
    f"""WITH {LOG_ROWS}, w AS (SELECT * FROM l
          WHERE regexp_full_match(source, 'src1[0-4]') AND coalesce(lang, '') <> 'en')
        SELECT doc_id, ts_ns, (SELECT count(*) FROM w) > 5000 AS truncated FROM w
        ORDER BY ts_ns, doc_id LIMIT 5000""",
)
def logs_forward(t):
    rows = log_records(t)
    wanted = [("source.name", "=~", "src1[0-4]"), ("lang", "!=", "en")]
    return S.log_range(
        rows, wanted, 0, 10**18, "forward", 5000, ties=["doc_id"]
    ).select("doc_id", "ts_ns", "truncated")


SPANS = "clients_src servers_src spans"


@query(
    "l6_trace_search",
    SPANS,
    """, tr AS (SELECT trace_id, min(ts_ns) AS start_ns, count(*) AS spans,
              bool_or(service_name = 'svc2') AS hit FROM spans
            WHERE ts_ns >= 600000 * 1000000000::BIGINT AND ts_ns < 660000 * 1000000000::BIGINT
            GROUP BY trace_id)
       SELECT trace_id, start_ns, spans, (SELECT count(*) FROM tr WHERE hit) > 20 AS truncated
       FROM tr WHERE hit ORDER BY start_ns DESC, trace_id LIMIT 20""",
)
def trace_search(t):
    return S.trace_search(t.spans, 600_000 * SECOND, 660_000 * SECOND, "svc2")


TRACE = "0" * 30 + "2b"


@query(
    "l6_get_trace",
    SPANS,
    f"""SELECT span_id, parent_span_id, service_name, span_kind, ts_ns FROM spans
        WHERE trace_id = '{TRACE}'""",
)
def get_trace(t):
    return S.get_trace(t.spans, TRACE).select(
        "span_id", "parent_span_id", "service_name", "span_kind", "ts_ns"
    )


@query(
    "l6_trace_metrics",
    SPANS,
    """SELECT service_name, (560000 + ((ts_ns - 560000 * 1000000000::BIGINT) // 3600000000000) * 3600)
           * 1000000000::BIGINT AS step_ns, count(*) AS spans,
         count(CASE WHEN status_code = 'STATUS_CODE_ERROR' THEN 1 END) AS errors FROM spans
       WHERE ts_ns >= 560000 * 1000000000::BIGINT AND ts_ns < 680000 * 1000000000::BIGINT
       GROUP BY ALL""",
)
def trace_metrics(t):
    return S.trace_metrics(
        t.spans, 560_000 * SECOND, 680_000 * SECOND, 3600 * SECOND, ["service_name"]
    )


@query(
    "l7_label_values",
    "points",
    """SELECT DISTINCT 'container' AS label, container AS value FROM points
       UNION SELECT 'namespace', namespace FROM points UNION SELECT 'service', service_name FROM points""",
)
def label_values(t):
    return S.label_values(labelled(t), "labels")


@query(
    "f82_metric_discovery",
    "points",
    """SELECT 'metric' AS kind, metric AS name FROM points GROUP BY metric
       UNION ALL SELECT 'label', l FROM (VALUES ('container'), ('namespace'), ('service')) v(l)
       UNION ALL SELECT DISTINCT 'namespace', namespace FROM points""",
)
def metric_discovery(t):
    rows = labelled(t)
    return (
        S.metric_names(rows).select(F.lit("metric").alias("kind"), F.col("metric").alias("name"))
        .unionByName(
            S.label_names(rows, "labels").select(
                F.lit("label").alias("kind"), F.col("label").alias("name")
            )
        )
        .unionByName(
            S.label_values(rows, "labels", "namespace").select(
                F.lit("namespace").alias("kind"), F.col("value").alias("name")
            )
        )
    )


@query(
    "f82_metric_series",
    "points",
    "SELECT DISTINCT metric, container, namespace, service_name FROM points",
)
def series(t):
    return S.metric_series(t.points, ["metric", "container", "namespace", "service_name"])


@query(
    "f83_span_tags",
    SPANS,
    """SELECT DISTINCT 'operation' AS tag, span_name AS value FROM spans
       UNION SELECT 'peer', peer FROM spans WHERE peer IS NOT NULL""",
)
def tags(t):
    attributes = N.drop_empty(F.create_map(F.lit("operation"), "span_name", F.lit("peer"), "peer"))
    return S.span_tag_values(t.spans.select(attributes.alias("attributes")), "attributes")


@query(
    "l7_span_tag_names",
    SPANS,
    """SELECT 'operation' AS tag FROM spans WHERE span_name IS NOT NULL GROUP BY 1
       UNION SELECT 'peer' FROM spans WHERE peer IS NOT NULL""",
)
def tag_names(t):
    attributes = N.drop_empty(F.create_map(F.lit("operation"), "span_name", F.lit("peer"), "peer"))
    return S.span_tags(t.spans.select(attributes.alias("attributes")), "attributes")


@query(
    "l8_visible_tables",
    "",
    """WITH r AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Main' WHEN 1 THEN 'graph' WHEN 2 THEN 'catalog'
            ELSE 'other' END AS s, CASE WHEN p_partkey % 6 = 0 THEN 'Table_Semantics' ELSE p_name END AS n,
            p_partkey FROM part)
       SELECT 'raw' AS treatment, p_partkey FROM r WHERE s IN ('Main', 'catalog')
         AND NOT (s = 'catalog' AND n = 'Table_Semantics')
       UNION ALL SELECT 'metadata', p_partkey FROM r WHERE s IN ('Main', 'catalog')
       UNION ALL SELECT 'graph', p_partkey FROM r WHERE s <> 'other'""",
)
def visible(t):
    k = F.col("p_partkey")
    tables = t.table("part").select(
        F.when(k % 4 == 0, "Main").when(k % 4 == 1, "graph").when(k % 4 == 2, "catalog")
        .otherwise("other").alias("table_schema"),
        F.when(k % 6 == 0, "Table_Semantics").otherwise(F.col("p_name")).alias("table_name"),
        "p_partkey",
    )
    parts = [
        S.visible_tables(tables, treatment, "main").select(
            F.lit(treatment).alias("treatment"), "p_partkey"
        )
        for treatment in ("raw", "metadata", "graph")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
