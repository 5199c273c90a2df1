"""Normalization, window and collapse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators import collapse as C
from faultline.operators import surface as S
from faultline.plans.registry import query


@query(
    "b1_to_nanoseconds",
    "",
    """WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000
         WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN epoch_us(ts)
         ELSE epoch_us(ts) * 1000 END AS t FROM events)
       SELECT event_id, CASE WHEN abs(t) < 100000000000 THEN t * 1000000000
         WHEN abs(t) < 100000000000000 THEN t * 1000000
         WHEN abs(t) < 100000000000000000 THEN t * 1000 ELSE t END AS ts_ns FROM r""",
)
def to_nanoseconds(t):
    us, k = F.col("ts_us"), F.col("event_id") % 4
    raw = (
        F.when(k == 0, W.floor_div(us, 1_000_000))
        .when(k == 1, W.floor_div(us, 1000))
        .when(k == 2, us)
        .otherwise(us * 1000)
    )
    return t.events.select("event_id", N.to_nanoseconds(raw).alias("ts_ns"))


@query(
    "b2_iso_nanoseconds",
    "",
    """SELECT event_id,
         CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE -28800 END::BIGINT * 1000000000
           + epoch_us(ts) * 1000 + (event_id % 1000) AS ts_ns,
         CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE -28800 END::BIGINT
           + epoch_us(ts) // 1000000 AS ts_s
       FROM events""",
)
def iso_nanoseconds(t):
    second = F.timestamp_seconds(W.floor_div("ts_us", 1_000_000))
    micros = F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0")
    nanos = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    k = F.col("event_id") % 3
    zone = F.when(k == 0, "Z").when(k == 1, "+00:00").otherwise("+0800")
    text = F.concat(
        F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), micros, nanos, zone
    )
    return t.events.select(
        "event_id",
        N.iso_to_nanoseconds(text).alias("ts_ns"),
        N.iso_to_seconds(text).alias("ts_s"),
    )


FOLD_M = r"regexp_replace({x}, '[^a-zA-Z0-9_:]', '_', 'g')"
FOLD_L = r"regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g')"


@query(
    "b3_metric_names",
    "",
    f"""SELECT p_partkey, CASE WHEN regexp_matches({FOLD_M.format(x='n')}, '^[a-zA-Z_:]')
            THEN {FOLD_M.format(x='n')} ELSE 'metric_' || {FOLD_M.format(x='n')} END AS metric
        FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '.' || p_name
                WHEN 1 THEN p_name || ':' || p_brand ELSE '' END AS n FROM part)""",
)
def metric_names(t):
    k = F.col("p_partkey") % 3
    name = (
        F.when(k == 0, F.concat_ws(".", F.col("p_partkey").cast("string"), "p_name"))
        .when(k == 1, F.concat_ws(":", "p_name", "p_brand"))
        .otherwise("")
    )
    return t.table("part").select("p_partkey", N.fold_metric_name(name).alias("metric"))


@query(
    "b4_label_names",
    "",
    f"""SELECT page_id, CASE WHEN regexp_matches({FOLD_L.format(x='url')}, '^[a-zA-Z_]')
            THEN {FOLD_L.format(x='url')} ELSE 'label_' || {FOLD_L.format(x='url')} END AS label
        FROM pages""",
)
def label_names(t):
    return t.table("pages").select("page_id", N.fold_label_name("url").alias("label"))


@query(
    "b5_fold_collisions",
    "",
    f"""SELECT folded, count(*) AS sources, min(s) AS first_source, max(s) AS last_source
        FROM (SELECT DISTINCT s, CASE WHEN regexp_matches({FOLD_M.format(x='s')}, '^[a-zA-Z_:]')
                THEN {FOLD_M.format(x='s')} ELSE 'metric_' || {FOLD_M.format(x='s')} END AS folded
              FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name
                      ELSE replace(p_name, ' ', '.') END AS s FROM part))
        GROUP BY folded HAVING count(*) > 1""",
)
def collisions(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(
        F.replace("p_name", F.lit(" "), F.lit("."))
    )
    names = t.table("part").select(name.alias("s"))
    return C.fold_collisions(names, "s", N.fold_metric_name("s"))


@query(
    "b6_attribute_map",
    "points",
    """SELECT src_order, container, deployment,
         (1 + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) + 1)::BIGINT AS attributes
       FROM points""",
)
def attribute_map(t):
    rows = t.points.select(
        "src_order",
        F.col("container").alias("attr.container"),
        F.col("deployment").alias("attr.deployment"),
        F.when(F.col("k") % 2 == 0, F.col("pod")).otherwise("").alias("attr.pod"),
        F.lit(None).cast("string").alias("attr.zone"),
        F.lit("Client").alias("attr.span_kind"),
    )
    attributes = N.attribute_map(rows.columns, excluded=("span_kind",))
    return rows.select("src_order", attributes.alias("a")).select(
        "src_order",
        F.col("a")["container"].alias("container"),
        F.col("a")["deployment"].alias("deployment"),
        F.size("a").cast("bigint").alias("attributes"),
    )


@query(
    "b7_service_identity",
    "points",
    """SELECT src_order, CASE WHEN k % 3 = 0 THEN service_name
           ELSE namespace || '/' || service_name END AS job,
           CASE WHEN k % 2 = 0 THEN pod END AS instance FROM points""",
)
def service_identity(t):
    resource = F.create_map(
        F.lit("service.name"), "service_name",
        F.lit("service.namespace"),
        F.when(F.col("k") % 3 == 0, "").otherwise(F.col("namespace")),
        F.lit("service.instance.id"),
        F.when(F.col("k") % 2 == 0, F.col("pod")),
    )
    return t.points.select("src_order", N.service_identity(resource).alias("i")).select(
        "src_order", F.col("i")["job"].alias("job"), F.col("i")["instance"].alias("instance")
    )


@query(
    "b8_label_values",
    "",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS flag,
         toxic::VARCHAR AS number,
         '{"quality":"' || quality || '","toxic":"' || toxic || '"}' AS object,
         '[' || quality || ',' || toxic || ']' AS list FROM labels""",
)
def label_value_texts(t):
    # Keys are given out of order; the canonical text sorts them.
    pairs = F.create_map(
        F.lit("toxic"), F.col("toxic").cast("string"),
        F.lit("quality"), F.col("quality").cast("string"),
    )
    return t.table("labels").select(
        "doc_id",
        N.canonical_label_value(F.col("quality") == 1, "boolean").alias("flag"),
        N.canonical_label_value("toxic", "int").alias("number"),
        N.canonical_label_value(pairs, "map").alias("object"),
        N.canonical_label_value(F.array("quality", "toxic"), "array").alias("list"),
    )


KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")


@query(
    "b9_span_codes",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         (l_partkey % 6)::INTEGER AS kind, (l_suppkey % 3)::INTEGER AS status,
         ['SPAN_KIND_UNSPECIFIED','SPAN_KIND_INTERNAL','SPAN_KIND_SERVER','SPAN_KIND_CLIENT',
          'SPAN_KIND_PRODUCER','SPAN_KIND_CONSUMER'][(l_partkey % 6 + 1)::INTEGER] AS kind_name,
         ['STATUS_CODE_UNSET','STATUS_CODE_OK','STATUS_CODE_ERROR'][(l_suppkey % 3 + 1)::INTEGER]
           AS status_text
       FROM lineitem""",
)
def span_codes(t):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    statuses = F.array(*[F.lit(s) for s in ("Unset", "Ok", "Error")])
    kind = F.get(kinds, (F.col("l_partkey") % 6).cast("int"))
    status = F.get(statuses, (F.col("l_suppkey") % 3).cast("int"))
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.span_kind_code(kind).alias("kind"),
        N.status_code(status).alias("status"),
    ).select(
        "*", N.span_kind_name("kind").alias("kind_name"), N.status_name("status").alias("status_text")
    )


def histogram_points(t):
    """Histogram points per metric, container and hour; one in four has no sum."""
    return (
        t.samples.groupBy("metric", "container", "ts_ms")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.sum("value"), 2).alias("total"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .withColumn("sum", F.when(F.col("count") % 4 != 0, F.col("total")))
        .withColumn("labels", F.create_map(F.lit("container"), "container"))
        .drop("total")
    )


HISTOGRAM = """h AS (SELECT metric, container, ts_ms, count(*) AS n,
  CASE WHEN count(*) % 4 <> 0 THEN round(sum(value), 2) END AS total
  FROM samples GROUP BY metric, container, ts_ms)"""


@query(
    "b10_histogram_samples",
    "points samples",
    f""", {HISTOGRAM}
        SELECT metric || '_count' AS metric, container, ts_ms, n::DOUBLE AS value, NULL AS le FROM h
        UNION ALL SELECT metric || '_sum', container, ts_ms, total, NULL FROM h WHERE total IS NOT NULL
        UNION ALL SELECT metric || '_bucket', container, ts_ms, n::DOUBLE, 'inf' FROM h""",
)
def fan_out(t):
    return C.histogram_samples(histogram_points(t)).select(
        "metric", "container", "ts_ms", "value", F.col("labels")["le"].alias("le")
    )


@query(
    "b11_finite_values",
    "points",
    """SELECT metric, count(*) AS rows,
         sum(CASE WHEN k % 10 = 0 OR k % 10 = 1 OR k % 10 = 2 THEN 0 ELSE 1 END)::BIGINT AS valid,
         max(CASE WHEN k % 10 > 2 THEN value END) AS highest FROM points GROUP BY metric""",
)
def finite(t):
    k = F.col("k") % 10
    value = (
        F.when(k == 0, F.lit(float("nan")))
        .when(k == 1, F.lit(float("inf")))
        .when(k == 2, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    broken = t.points.withColumn("value", value)
    valid = N.is_finite("value")
    return broken.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid).alias("valid"),
        F.max(F.when(valid, F.col("value"))).alias("highest"),
    )


@query(
    "b12_span_ends",
    "clients_src servers_src spans",
    """SELECT service_name, count(*) AS spans, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END)::BIGINT AS cut,
         max(greatest(ts_ns + d, ts_ns)) AS last_end
       FROM (SELECT *, (end_ns - ts_ns) - 20000000 AS d FROM spans) GROUP BY service_name""",
)
def span_ends(t):
    duration = F.col("end_ns") - F.col("ts_ns") - 20_000_000
    end = N.span_end("ts_ns", duration)
    return t.spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(duration < 0).alias("cut"),
        F.max(end).alias("last_end"),
    )


IDS = """ids AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'id-' || user_id
    WHEN event_id % 5 = 1 THEN '00000000000000000000000000000000'
    ELSE lpad(lower(to_hex(event_id)), 32, '0') END AS id FROM events)"""


def mixed_ids(t):
    k = F.col("event_id") % 5
    return t.events.select(
        "event_id",
        F.when(k == 0, F.concat(F.lit("id-"), "user_id"))
        .when(k == 1, "0" * 32)
        .otherwise(F.lpad(F.lower(F.hex("event_id")), 32, "0"))
        .alias("id"),
    )


@query(
    "b13_valid_ids",
    "",
    f"""WITH {IDS} SELECT event_id, event_id % 5 > 1 AS valid, event_id % 5 > 0 AS valid_or_zero
        FROM ids""",
)
def valid_ids(t):
    return mixed_ids(t).select(
        "event_id",
        N.valid_hex_id("id", 16).alias("valid"),
        N.valid_hex_id("id", 16, allow_zero=True).alias("valid_or_zero"),
    )


@query(
    "b14_surrogate_ids",
    "",
    f"""WITH {IDS} SELECT event_id, CASE WHEN event_id % 5 > 1 THEN id
          ELSE substr(sha256('trace:' || id), 1, 32) END AS trace_id FROM ids""",
)
def surrogates(t):
    return mixed_ids(t).select("event_id", N.surrogate_id("id", 16, "trace").alias("trace_id"))


@query(
    "b14_remapped_ids",
    "",
    f"WITH {IDS} SELECT count(DISTINCT id) AS remapped FROM ids WHERE event_id % 5 <= 1",
)
def remapped(t):
    from faultline.operators.audit import id_remapping

    return id_remapping(mixed_ids(t), "id", 16)


CATEGORIES = """CASE WHEN contains(x, 'memory') THEN 'memory' WHEN contains(x, 'cpu') THEN 'cpu'
 WHEN contains(x, 'i/o') OR contains(x, 'disk') THEN 'disk'
 WHEN contains(x, 'latency') OR contains(x, 'delay') OR contains(x, 'response time') THEN 'delay'
 WHEN contains(x, 'loss') THEN 'loss' ELSE 'other' END"""
KIND_CATEGORIES = """CASE
 WHEN contains(x, 'delay') OR contains(x, 'latency') OR contains(x, 'time') THEN 'delay'
 WHEN contains(x, 'loss') OR contains(x, 'abort') OR contains(x, 'disconnect') THEN 'loss'
 WHEN contains(x, 'cpu') THEN 'cpu'
 WHEN contains(x, 'memory') OR contains(x, 'oom') OR contains(x, 'gc') THEN 'memory'
 WHEN contains(x, 'disk') OR contains(x, 'io') THEN 'disk' ELSE 'other' END"""
NODE_CATEGORIES = """CASE WHEN contains(x, 'cpu') THEN 'cpu'
 WHEN contains(x, 'memory') OR contains(x, 'oom') OR contains(x, 'gc') THEN 'memory'
 WHEN contains(x, 'disk') OR contains(x, 'iohigh') THEN 'disk'
 WHEN contains(x, 'latency') OR x IN ('slowsql', 'slowresource') THEN 'delay' ELSE 'other' END"""


@query(
    "b15_fault_categories",
    "",
    f"""SELECT doc_id, {CATEGORIES} AS by_reason, {KIND_CATEGORIES} AS by_kind,
               {NODE_CATEGORIES} AS by_node
        FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'Node CPU Load ' || text
                WHEN 1 THEN 'High I/O Read' WHEN 2 THEN 'SlowSQL' ELSE text END) AS x
              FROM documents)""",
)
def categories(t):
    k = F.col("doc_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Node CPU Load "), "text"))
        .when(k == 1, "High I/O Read")
        .when(k == 2, "SlowSQL")
        .otherwise(F.col("text"))
    )
    return t.table("documents").select(
        "doc_id",
        N.fault_category(text, "reason").alias("by_reason"),
        N.fault_category(text, "kind").alias("by_kind"),
        N.fault_category(text, "node").alias("by_node"),
    )


@query(
    "b16_component_matches",
    "",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true
         WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS matches,
         c_custkey % 7 IN (0, 1, 2) AS matches_plain
       FROM customer""",
)
def component_matches(t):
    k = F.col("c_custkey") % 7
    name = F.col("c_mktsegment")
    pod = F.concat(F.lower(name), F.lit("-7c6c"))
    predicted = (
        F.when(k == 0, F.concat(F.lower(name), F.lit("-service (primary)")))
        .when(k == 1, F.concat(name, F.lit(" Pod Container")))
        .when(k == 2, F.concat(F.lit(" "), F.lower(name)))
        .when(k == 3, F.concat(name, F.lit(" pod other-1")))
        .when(k == 4, F.concat(name, F.lit(" pod "), pod))
        .when(k == 5, pod)
        .otherwise("frontend")
    )
    return t.table("customer").select(
        "c_custkey",
        N.component_matches(predicted, name, F.array(pod)).alias("matches"),
        N.component_matches(predicted, name).alias("matches_plain"),
    )


@query(
    "b17_fault_types",
    "",
    """SELECT p_partkey, p_partkey % 2 = 0 AS matches,
         CASE WHEN p_partkey % 3 = 0 THEN 'memory' ELSE lower(p_type) END AS category FROM part""",
)
def fault_types(t):
    even = F.col("p_partkey") % 2 == 0
    predicted = F.when(even, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise("x")
    native = F.when(F.col("p_partkey") % 3 == 0, " Mem ").otherwise(F.col("p_type"))
    return t.table("part").select(
        "p_partkey",
        N.fault_type_matches(predicted, "p_name").alias("matches"),
        N.category_alias(native).alias("category"),
    )


def record_labels():
    return F.create_map(
        F.lit("source.name"), "source",
        F.lit("lang"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")),
        F.lit("trace_id"), F.when(F.col("doc_id") % 2 == 0, F.hex("doc_id")),
    )


@query(
    "b18_stream_labels",
    "",
    """SELECT doc_id, source AS source_name, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang,
         'logs' AS log_table, CASE WHEN doc_id % 2 = 0 THEN to_hex(doc_id) END AS trace_id,
         (2 + CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END)::BIGINT AS stream_labels
       FROM documents""",
)
def stream_labels(t):
    rows = t.table("documents").select(
        "doc_id",
        N.stream_labels(record_labels(), F.lit("logs")).alias("s"),
        N.entry_metadata(record_labels()).alias("m"),
    )
    return rows.select(
        "doc_id",
        F.col("s")["source_name"].alias("source_name"),
        F.col("s")["lang"].alias("lang"),
        F.col("s")["log_table"].alias("log_table"),
        F.col("m")["trace_id"].alias("trace_id"),
        F.size("s").cast("bigint").alias("stream_labels"),
    )


@query(
    "b19_spread_labels",
    "points",
    """SELECT container, namespace, CASE WHEN k % 2 = 0 THEN 'x' END AS value,
         src_order, value AS value_ FROM points""",
)
def spread(t):
    return C.spread_labels(mapped_points(t), "labels", ["container", "namespace", "value"])


@query(
    "b19_label_order",
    "points",
    """SELECT 'container' AS label, min(src_order) AS row FROM points WHERE container IS NOT NULL
       UNION ALL SELECT 'namespace', min(src_order) FROM points WHERE namespace IS NOT NULL
       UNION ALL SELECT 'value', min(src_order) FROM points WHERE k % 2 = 0""",
)
def label_order(t):
    return C.label_order(mapped_points(t), "labels", "src_order").select("label", "row")


def mapped_points(t):
    labels = N.drop_empty(
        F.create_map(
            F.lit("container"), "container", F.lit("namespace"), "namespace",
            F.lit("value"), F.when(F.col("k") % 2 == 0, "x"),
        )
    )
    return t.points.select(labels.alias("labels"), "src_order", "value")


@query(
    "b20_padded_trace_ids",
    "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL
         ELSE lpad(lower(to_hex(o_orderkey)), 32, '0') END AS trace_id FROM orders""",
)
def padded(t):
    raw = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("trace-"), "o_orderkey")).otherwise(
        F.hex("o_orderkey")
    )
    return t.table("orders").select("o_orderkey", N.padded_trace_id(raw).alias("trace_id"))


@query(
    "b21_structured_targets",
    "",
    """SELECT o_orderkey, o_orderkey % 3 <> 2 AS scoreable,
         CASE WHEN o_orderkey % 3 = 2 THEN 'peer-' || o_custkey ELSE '' END AS alternatives
       FROM orders""",
)
def structured(t):
    name = F.concat(F.lit("Svc_"), F.col("o_custkey"))
    other = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("peer-"), "o_custkey")).otherwise(
        F.lower(name)
    )
    target = F.array(
        F.struct(name.alias("entity_name")), F.struct(other.alias("entity_name")),
        F.struct(F.lit("").alias("entity_name")), F.struct(other.alias("entity_name")),
    )
    payload = F.when(
        F.col("o_orderkey") % 3 > 0,
        F.to_json(F.struct(F.struct(target.alias("target_entities")).alias("outcome"))),
    )
    found = N.structured_targets(name, payload)
    return t.table("orders").select(
        "o_orderkey",
        (F.size(found) == 0).alias("scoreable"),
        F.array_join(found, ",").alias("alternatives"),
    )


def loci(t):
    k = F.col("o_orderkey")
    service = F.concat(F.lit("svc"), F.col("o_custkey") % 5)
    return t.table("orders").select(
        "o_orderkey",
        F.when(k % 2 == 0, "edge").otherwise("component").alias("scope"),
        F.when(k % 3 != 0, service).alias("component"),
        F.when(k % 3 != 1, service).alias("source"),
        F.when(k % 3 == 0, "db").alias("destination"),
    )


@query(
    "b22_locus_shapes",
    "",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 2 = 0
         WHEN 1 THEN o_orderkey % 2 = 1 ELSE false END AS valid FROM orders""",
)
def shapes(t):
    return loci(t).select(
        "o_orderkey",
        N.locus_shape_valid("scope", "component", "source", "destination").alias("valid"),
    )


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "b23_describe_table",
    "",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, {i} AS ordinal, {c == 'ts'} AS time_index, {c == 'user_id'} AS primary_key,
              count(*) AS rows, count(*) - count({c}) AS nulls,
              {'epoch_us(min(ts))' if c == 'ts' else 'NULL::BIGINT'} AS first_us,
              {'epoch_us(max(ts))' if c == 'ts' else 'NULL::BIGINT'} AS last_us FROM events"""
        for i, c in enumerate(EVENT_COLUMNS)
    ),
)
def describe(t):
    described = S.describe_table(t.table("events"), {"ts": "timestamp", "user_id": "tag"})
    ends = [F.unix_micros(F.col(f"{c}_time").cast("timestamp")).alias(f"{c}_us") for c in ("first", "last")]
    return described.select("name", "ordinal", "time_index", "primary_key", "rows", "nulls", *ends)


@query(
    "b24_target_labels",
    "",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'svc' || (o_custkey % 5) || ' -> db'
         ELSE 'svc' || (o_custkey % 5) END AS target FROM orders""",
)
def targets(t):
    return loci(t).select(
        "o_orderkey", N.target_label("component", "source", "destination").alias("target")
    )


@query(
    "c1_half_open_window",
    "",
    """SELECT event_type, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id
       FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'
       GROUP BY event_type""",
)
def half_open(t):
    low = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    high = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    rows = t.table("events").where(W.half_open("ts", low, high))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


@query(
    "c2_closed_window",
    "points",
    """SELECT metric, count(*) AS rows FROM points
       WHERE ts_ns // 1000000 BETWEEN 1704412800000 AND 1705276800000 GROUP BY metric""",
)
def closed(t):
    ms = W.floor_div("ts_ns", 1_000_000)
    rows = t.points.where(W.closed(ms, 1704412800, 1705276800, 1000))
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c3_minute_envelopes",
    "points",
    """SELECT src_order, (ts_s // 60) * 60 AS low, ((ts_s + k + 59) // 60) * 60 AS high,
         ts_s - 300 AS scan_low, ts_s + k + 3600 AS scan_high FROM points""",
)
def envelopes(t):
    low, high = W.minute_envelope("ts_s", F.col("ts_s") + F.col("k"))
    scan_low, scan_high = W.server_scan("ts_s", F.col("ts_s") + F.col("k"))
    return t.points.select(
        "src_order", low.alias("low"), high.alias("high"), scan_low.alias("scan_low"),
        scan_high.alias("scan_high"),
    )


@query(
    "c4_period_tags",
    "points",
    """SELECT metric, CASE WHEN ts_s < 1705276800 THEN 'normal' ELSE 'abnormal' END AS period,
         count(*) AS rows FROM points GROUP BY ALL""",
)
def period_tags(t):
    period = W.period_by_boundary("ts_s", 1705276800)
    return t.points.groupBy("metric", period.alias("period")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c5_periods",
    "points",
    """SELECT CASE WHEN ts_s >= 1704412800 AND ts_s < 1705276800 THEN 'normal'
         WHEN ts_s >= 1705276800 AND ts_s < 1706140800 THEN 'abnormal' END AS period,
         count(*) AS rows FROM points GROUP BY 1""",
)
def periods(t):
    period = W.period_of("ts_s", 1704412800, 1705276800, 1706140800)
    return t.points.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c6_bucket_periods",
    "points",
    """, b AS (SELECT (ts_s // 7000) * 7000 AS s, count(*) AS n FROM points GROUP BY 1)
       SELECT s AS bucket_start, n AS rows, CASE
         WHEN s >= 1704412800 AND s + 6999 < 1705276800 THEN 'normal'
         WHEN s >= 1705276800 AND s + 6999 < 1706140800 THEN 'abnormal' END AS period FROM b""",
)
def bucket_periods(t):
    start = W.floor_to("ts_s", 7000)
    buckets = t.points.groupBy(start.alias("bucket_start")).agg(F.count(F.lit(1)).alias("rows"))
    period = W.bucket_period("bucket_start", 7000, 1704412800, 1705276800, 1706140800)
    return buckets.withColumn("period", period)


@query(
    "c7_time_buckets",
    "points",
    "SELECT (ts_s // 900) * 900 AS bucket, metric, count(*) AS rows FROM points GROUP BY ALL",
)
def buckets(t):
    bucket = W.floor_to("ts_s", 900)
    return t.points.groupBy(bucket.alias("bucket"), "metric").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c8_baseline_windows",
    "points",
    "SELECT src_order, ts_s - (k + 60) AS baseline_start, ts_s AS baseline_end FROM points",
)
def baselines(t):
    low, high = W.baseline_window("ts_s", F.col("ts_s") + F.col("k") + 60)
    return t.points.select(
        "src_order", low.alias("baseline_start"), high.alias("baseline_end")
    )


def submitted_bounds(t):
    """Time ranges as a submitted filter states them, around windows 100..200..300."""
    k = F.col("k")
    return t.points.select(
        "src_order",
        F.when(k % 4 == 3, "gt").otherwise("gte").alias("lo_op"),
        F.when(k % 13 == 12, F.lit(None)).otherwise(F.lit(100) + (k % 3) * 50).alias("lo"),
        F.when(k % 2 == 0, "lt").otherwise("lte").alias("hi_op"),
        (F.lit(150) + (k % 4) * 50).alias("hi"),
    )


@query(
    "c9_time_coverage",
    "points",
    """, b AS (SELECT src_order, CASE WHEN k % 4 = 3 THEN 'gt' ELSE 'gte' END AS lo_op,
           CASE WHEN k % 13 = 12 THEN NULL ELSE 100 + (k % 3) * 50 END AS lo,
           CASE WHEN k % 2 = 0 THEN 'lt' ELSE 'lte' END AS hi_op, 150 + (k % 4) * 50 AS hi
           FROM points)
       SELECT src_order,
         CASE WHEN lo >= hi OR lo IS NULL THEN NULL
              WHEN lo = 100 AND hi = 300 AND lo_op = 'gte' THEN 'abnormal,normal'
              WHEN lo >= 100 AND hi <= 200 THEN 'normal'
              WHEN lo >= 200 AND hi <= 300 THEN 'abnormal' END AS periods,
         CASE WHEN lo >= hi OR lo IS NULL THEN NULL
              WHEN lo = 100 AND hi = 300 AND lo_op = 'gte' THEN 'abnormal,normal'
              WHEN lo >= 100 AND hi <= 200
                THEN CASE WHEN lo = 100 AND hi = 200 AND lo_op = 'gte' THEN 'normal' ELSE '' END
              WHEN lo >= 200 AND hi <= 300
                THEN CASE WHEN lo = 200 AND hi = 300 AND lo_op = 'gte' THEN 'abnormal' ELSE '' END
              END AS complete,
         coalesce((lo < 100 OR (lo = 100 AND lo_op = 'gte')) AND hi >= 300, false) AS listing_covers
       FROM b""",
)
def coverage(t):
    args = ("lo_op", "lo", "hi_op", "hi")
    periods, complete = W.time_coverage(*args, 100, 200, 300)
    return submitted_bounds(t).select(
        "src_order",
        F.array_join(periods, ",").alias("periods"),
        F.array_join(complete, ",").alias("complete"),
        W.unfiltered_coverage(*args, 100, 300).alias("listing_covers"),
    )


@query(
    "c11_equality_filters",
    "observations",
    """SELECT src_id, dst_id, count(*) AS rows FROM observations
       WHERE rel_type = 'calls' AND provenance = 'trace' GROUP BY src_id, dst_id""",
)
def equality(t):
    filters = {"rel_type": "calls", "src_id": "", "dst_type": None, "provenance": "trace"}
    rows = S.equal_filters(t.observations, filters, S.EDGE_FILTERS)
    return rows.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("rows"))


def labelled(t):
    labels = F.create_map(
        F.lit("container"), "container", F.lit("namespace"), "namespace",
        F.lit("service"), "service_name",
    )
    return t.points.withColumn("labels", labels)


@query(
    "c12_label_matchers",
    "points",
    """SELECT metric, container, count(*) AS rows FROM points
       WHERE namespace = 'ns1' AND service_name <> 'svc0'
         AND regexp_full_match(container, 'c1?[1-5]') GROUP BY metric, container""",
)
def matchers(t):
    wanted = [
        ("namespace", "=", "ns1"), ("service", "!=", "svc0"), ("container", "=~", "c1?[1-5]"),
        ("missing", "!~", "x.*"),
    ]
    rows = labelled(t).where(S.matching("labels", wanted))
    return rows.groupBy("metric", "container").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "c14_case_context",
    "",
    """WITH c AS (SELECT o_orderkey,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS s,
           o_orderkey + o_custkey % 50 - 5 AS e,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey + o_custkey % 30 END AS a,
           o_orderkey + o_custkey % 60 AS i FROM orders)
       SELECT o_orderkey, CASE WHEN s <= e THEN e - s END AS window_seconds,
         CASE WHEN s <= e AND a IS NOT NULL THEN greatest(0, least(a, e) - s) END
           AS telemetry_before_alert_seconds,
         CASE WHEN s <= e AND i BETWEEN s AND e THEN i - s END AS known_pre_fault_seconds,
         CASE WHEN s <= e AND i BETWEEN s AND e THEN e - i END AS known_post_fault_seconds,
         CASE WHEN s <= e AND i BETWEEN s AND e THEN 'known' ELSE 'unknown' END AS baseline_status
       FROM c""",
)
def context(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    columns = W.context(
        F.when(k % 11 != 0, k), k + c % 50 - 5, F.when(k % 7 != 0, k + c % 30), k + c % 60
    )
    return t.table("orders").select("o_orderkey", *[v.alias(n) for n, v in columns.items()])


@query(
    "d1_last_observation",
    "points samples",
    """SELECT metric, container, ts_ms, arg_max(value, src_order) AS value,
         count(*) AS observations, count(DISTINCT value) > 1 AS ambiguous
       FROM samples GROUP BY metric, container, ts_ms""",
)
def last_wins(t):
    return C.last_observation(t.samples, ["metric", "container", "ts_ms"], "value", ["src_order"])


@query(
    "d1_collapse_audit",
    "points samples",
    """, g AS (SELECT count(*) AS n, count(DISTINCT value) AS d FROM samples
               GROUP BY metric, container, ts_ms)
       SELECT sum(n)::BIGINT AS source_observations, count(*) AS kept_samples,
         sum(n - 1)::BIGINT AS repeated_observations,
         sum(CASE WHEN d > 1 THEN 1 ELSE 0 END)::BIGINT AS ambiguous_identities,
         sum(CASE WHEN d > 1 THEN n ELSE 0 END)::BIGINT AS ambiguous_observations FROM g""",
)
def collapse_audit(t):
    return C.collapse_audit(last_wins(t))


@query(
    "d2_sample_audit",
    "",
    """WITH g AS (SELECT count(*) AS n, count(v) AS valid, count(DISTINCT v) AS d FROM
         (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 3 THEN l_quantity END AS v
          FROM lineitem) GROUP BY l_orderkey, l_linenumber)
       SELECT sum(n)::BIGINT AS source_rows, sum(valid)::BIGINT AS valid_samples,
         sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END)::BIGINT AS unique_samples,
         (sum(valid) - sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END))::BIGINT AS duplicate_samples,
         sum(CASE WHEN d > 1 THEN 1 ELSE 0 END)::BIGINT AS conflicting_timestamps FROM g""",
)
def sample_audit(t):
    value = F.when(F.col("l_quantity") > 3, F.col("l_quantity")).otherwise(F.lit(float("nan")))
    rows = t.table("lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))
    return C.sample_audit(rows, ["l_orderkey", "l_linenumber"], "value")


@query(
    "d3_protocol_rows",
    "points samples",
    f""", {HISTOGRAM}
        SELECT count(*) AS protocol_rows FROM (
          SELECT DISTINCT metric, container, ts_ms FROM samples
          UNION SELECT metric || '_count', container, ts_ms FROM h
          UNION SELECT metric || '_sum', container, ts_ms FROM h WHERE total IS NOT NULL
          UNION SELECT metric || '_bucket', container, ts_ms FROM h)""",
)
def protocol_rows(t):
    return C.protocol_rows(t.samples, histogram_points(t), ["metric", "container", "ts_ms"])


@query(
    "d4_kind_collisions",
    "points",
    """SELECT metric, count(DISTINCT kind) AS kinds FROM (
         SELECT metric || '_' || (user_id % 30) AS metric,
                CASE WHEN user_id % 4 = 0 THEN 'sum' WHEN user_id % 30 > 20 THEN 'histogram'
                     ELSE 'gauge' END AS kind FROM points)
       GROUP BY metric HAVING count(DISTINCT kind) > 1""",
)
def kind_collisions(t):
    user = F.col("user_id")
    rows = t.points.select(
        F.concat_ws("_", "metric", (user % 30).cast("string")).alias("metric"),
        F.when(user % 4 == 0, "sum").when(user % 30 > 20, "histogram").otherwise("gauge").alias("kind"),
    )
    return C.kind_collisions(rows, "metric", "kind")


STORED = """src AS (SELECT l_orderkey AS trace, l_linenumber AS line, l_returnflag AS flag FROM lineitem),
 stored AS (SELECT DISTINCT l_orderkey AS trace, l_linenumber AS line, l_returnflag AS flag
   FROM lineitem WHERE l_orderkey % 50 <> 0
   UNION ALL SELECT l_orderkey, l_linenumber, 'X' FROM lineitem WHERE l_suppkey % 40 = 0)"""


def stored_copy(t):
    """A source of records and a stored copy that collapsed some, lost some and gained some."""
    rows = t.table("lineitem")
    source = rows.select(
        F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"), "l_suppkey",
    )
    kept = source.where(F.col("trace") % 50 != 0).select("trace", "line", "flag").distinct()
    gained = source.where(F.col("l_suppkey") % 40 == 0).select(
        "trace", "line", F.lit("X").alias("flag")
    )
    return source.drop("l_suppkey"), kept.unionByName(gained)


@query(
    "d5_presence_and_multiplicity",
    "",
    f"""WITH {STORED}, a AS (SELECT trace, line, flag, count(*) AS n FROM src GROUP BY ALL),
          b AS (SELECT trace, line, flag, count(*) AS n FROM stored GROUP BY ALL)
        SELECT coalesce(a.trace, b.trace) AS trace, coalesce(a.line, b.line) AS line,
          coalesce(a.flag, b.flag) AS flag, coalesce(a.n, 0) AS source_copies,
          coalesce(b.n, 0) AS stored_copies, a.n IS NOT NULL AND b.n IS NULL AS missing,
          greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra
        FROM a FULL OUTER JOIN b ON a.trace = b.trace AND a.line = b.line AND a.flag = b.flag""",
)
def presence(t):
    return C.presence_and_multiplicity(*stored_copy(t), ["trace", "line", "flag"])


@query(
    "d6_repeated_calls",
    "",
    """SELECT user_id, (count(*) - count(DISTINCT (event_type, props)))::BIGINT
         AS exact_repeated_calls FROM events GROUP BY user_id""",
)
def repeated(t):
    return C.repeated_calls(t.table("events"), "user_id", ["event_type", "props"])


def incident_windows(t):
    """Orders as incidents on a node, each open for a few days."""
    days = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    return t.table("orders").select(
        (F.col("o_custkey") % 40).alias("node"),
        F.col("o_orderkey").alias("case_id"),
        days.alias("start"),
        (days + 1 + F.col("o_orderkey") % 4).alias("end"),
    )


@query(
    "d7_duplicate_incidents",
    "",
    """WITH RECURSIVE c AS (SELECT o_custkey % 40 AS node, o_orderkey AS case_id,
           date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS s,
           date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 1 + o_orderkey % 4 AS e,
           row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS i FROM orders),
       r AS (SELECT DISTINCT node, 0::BIGINT AS i, NULL::BIGINT AS case_id, NULL::BIGINT AS s,
               NULL::BIGINT AS e, false AS dup, []::STRUCT(s BIGINT, e BIGINT)[] AS kept FROM c
             UNION ALL
             SELECT node, i, case_id, s, e, dup,
               CASE WHEN dup THEN kept ELSE list_append(kept, {'s': s, 'e': e}) END
             FROM (SELECT c.node, c.i, c.case_id, c.s, c.e, r.kept,
                     len(list_filter(r.kept, lambda k: c.s < k.e AND k.s < c.e)) > 0 AS dup
                   FROM r JOIN c ON c.node = r.node AND c.i = r.i + 1))
       SELECT node, case_id, s AS start, e AS "end", dup AS duplicate FROM r WHERE i > 0""",
)
def duplicates(t):
    return C.duplicate_incidents(incident_windows(t), "node", "case_id", "start", "end", 30)


@query(
    "d8_identity_unique",
    "clients_src servers_src spans",
    """, g AS (SELECT count(*) AS n FROM spans GROUP BY trace_id, span_id)
       SELECT sum(n)::BIGINT AS rows, count(*) AS identities, max(n) = 1 AS "unique" FROM g""",
)
def identity(t):
    return C.identity_unique(t.spans, ["trace_id", "span_id"])


@query(
    "d9_first_appearance",
    "",
    """SELECT user_id, event_type, min(event_id) AS first_ordinal FROM events
       GROUP BY user_id, event_type""",
)
def appearance(t):
    return C.first_appearance(t.table("events"), ["user_id"], "event_type", "event_id")
