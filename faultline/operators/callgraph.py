"""Trace-derived service call graph.

Spans carry: trace_id, span_id, parent_span_id, service_name, span_kind,
status_code, span_name, ts_ns, end_ns. Times are epoch nanoseconds, windows
epoch seconds and half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import windows as W

SECOND = 1_000_000_000
CLIENT, SERVER = "SPAN_KIND_CLIENT", "SPAN_KIND_SERVER"
ERROR = "STATUS_CODE_ERROR"
EDGE = ["src_type", "src_id", "dst_type", "dst_id", "rel_type", "provenance"]
#: The id in which both sides of a call agree: a server's parent, the span itself otherwise.
LINK = "link_id"


def link_id() -> Column:
    """The pairing key of a span within its trace; stored spans carry it as a column."""
    return F.when(F.col("span_kind") == SERVER, F.col("parent_span_id")).otherwise(F.col("span_id"))


def _linked(rows: DataFrame, own: str) -> DataFrame:
    """A stored link is kept as it is, so that the layout of the table serves the join."""
    return rows if LINK in rows.columns else rows.withColumn(LINK, F.col(own))


def clients(spans: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    rows = spans.where((F.col("span_kind") == CLIENT) & (F.col("span_id") != ""))
    if window:
        rows = rows.where(W.half_open("ts_ns", window[0] * SECOND, window[1] * SECOND))
    return _linked(rows, "span_id")


def servers(spans: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    rows = spans.where((F.col("span_kind") == SERVER) & (F.col("parent_span_id") != ""))
    if window:
        # The widened scan repeats the join bound as a plain range, so that the
        # source can skip row groups before the shuffle.
        low, high = window[0] - 300, window[1] + 3600
        rows = rows.where(W.half_open("ts_ns", low * SECOND, high * SECOND))
    return _linked(rows, "parent_span_id")


def _child(c: str = "c", s: str = "s") -> Column:
    return (F.col(f"{c}.trace_id") == F.col(f"{s}.trace_id")) & (
        F.col(f"{c}.{LINK}") == F.col(f"{s}.{LINK}")
    )


def _in_reach(before: int = 300, after: int = 3600) -> Column:
    gap = F.col("s.ts_ns") - F.col("c.ts_ns")
    return (gap >= F.lit(-before * SECOND)) & (gap <= F.lit(after * SECOND))


def span_pairs(
    spans: DataFrame,
    window: tuple[int, int] | None = None,
    exclude_self: bool = True,
    caller: str | None = None,
    bounded: bool = True,
) -> DataFrame:
    """E1/E2. Client spans with their direct server children.

    One row per server span, given unique span identities (`identity_unique`).
    The equality on trace and span id shuffles well even for one huge trace;
    the time bound is checked inside of the join.
    """
    left = clients(spans, window)
    if caller is not None:
        left = left.where(F.col("service_name") == caller)
    on = _child()
    if bounded:
        on = on & _in_reach()
    if exclude_self:
        on = on & (F.col("c.service_name") != F.col("s.service_name"))
    return (
        left.select("trace_id", LINK, "span_id", "service_name", "ts_ns", "end_ns", "span_name")
        .alias("c")
        .join(
            servers(spans, window)
            .select(
                "trace_id", LINK, "span_id", "service_name", "ts_ns", "end_ns", "status_code",
                "span_name",
            )
            .alias("s"),
            on,
        )
        .select(
            F.col("c.trace_id").alias("trace_id"),
            F.col("c.span_id").alias("client_span_id"),
            F.col("s.span_id").alias("server_span_id"),
            F.col("c.service_name").alias("src_id"),
            F.col("s.service_name").alias("dst_id"),
            F.col("c.ts_ns").alias("client_ns"),
            F.col("s.ts_ns").alias("server_ns"),
            F.col("s.end_ns").alias("server_end_ns"),
            (F.col("s.status_code") == ERROR).alias("error"),
            F.col("c.span_name").alias("client_operation"),
            F.col("s.span_name").alias("server_operation"),
        )
    )


def unpaired_clients(spans: DataFrame, window: tuple[int, int] | None = None) -> DataFrame:
    """E3. Client spans without any server child in reach."""
    left = clients(spans, window).alias("c")
    right = servers(spans, window).select("trace_id", LINK, "ts_ns").alias("s")
    return left.join(right, _child() & _in_reach(), "left_anti").select(*spans.columns)


def call_edges(pairs: DataFrame) -> DataFrame:
    """F1. Requests and errors per directed service edge."""
    return (
        pairs.groupBy("src_id", "dst_id")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if("error").alias("error_count"),
        )
        .select(
            F.lit("service").alias("src_type"),
            "src_id",
            F.lit("service").alias("dst_type"),
            "dst_id",
            F.lit("calls").alias("rel_type"),
            F.lit("trace").alias("provenance"),
            "request_count",
            "error_count",
        )
    )


def edge_observations(
    spans: DataFrame,
    window: tuple[int, int] | None = None,
    bin_seconds: int = 60,
    peer: str | None = None,
    peer_confidence: float = 0.5,
) -> DataFrame:
    """F2. RED observations of every edge in bins of the client's time.

    With `peer`, clients without a server child become virtual edges to the
    peer they name, with a lower confidence and an unmatched count.
    """
    width = bin_seconds * SECOND
    kept = ["trace_id", LINK, "service_name", "ts_ns"] + ([peer] if peer else [])
    # One join serves both kinds of edges: an outer row without a server is an
    # unmatched client. A child in its own service matches, but is no call.
    joined = (
        clients(spans, window)
        .select(*kept)
        .alias("c")
        .join(
            servers(spans, window)
            .select("trace_id", LINK, "service_name", "ts_ns", "end_ns", "status_code")
            .alias("s"),
            _child() & _in_reach(),
            "left" if peer else "inner",
        )
    )
    matched = F.col("s.trace_id").isNotNull()
    callee = F.col("s.service_name")
    if peer:
        callee = F.when(matched, callee).otherwise(F.col(f"c.{peer}"))
    duration = F.when(matched, F.col("s.end_ns") - F.col("s.ts_ns"))
    calls = joined.select(
        W.floor_to("c.ts_ns", width).alias("window_ns"),
        F.col("c.service_name").alias("src_id"),
        callee.alias("dst_id"),
        matched.alias("matched"),
        (F.col("s.status_code") == ERROR).alias("error"),
        duration.alias("duration"),
    ).where(
        F.col("dst_id").isNotNull() & (~F.col("matched") | (F.col("src_id") != F.col("dst_id")))
    )
    paired = calls.groupBy("window_ns", "src_id", "dst_id", "matched").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(~F.col("matched")).alias("unmatched_count"),
        F.count_if("error").alias("error_count"),
        F.sum(F.col("duration").cast("decimal(38,0)")).cast("double").alias("duration_sum"),
        F.count("duration").alias("duration_count"),
        F.max("duration").cast("double").alias("duration_max"),
    ).withColumn("confidence", F.when(F.col("matched"), 1.0).otherwise(F.lit(peer_confidence)))
    start = W.floor_div("window_ns", SECOND)
    return paired.select(
        start.alias("window_start"),
        (start + bin_seconds).alias("window_end"),
        start.alias("observed_at"),
        F.lit("service").alias("src_type"),
        "src_id",
        F.lit("service").alias("dst_type"),
        "dst_id",
        F.lit("calls").alias("rel_type"),
        F.lit("trace").alias("provenance"),
        "confidence",
        "request_count",
        "unmatched_count",
        "error_count",
        "duration_sum",
        "duration_count",
        "duration_max",
    )


MEASURES = [
    "confidence", "request_count", "unmatched_count", "error_count", "duration_sum",
    "duration_count", "duration_max",
]


def window_relationships(observations: DataFrame, attributes: str | None = None) -> DataFrame:
    """F3. One row per window and edge; repeats of an observation collapse to their maximum."""
    keys = ["window_start", "window_end", *EDGE] + ([attributes] if attributes else [])
    return observations.groupBy(*keys).agg(*[F.max(m).alias(m) for m in MEASURES])


def range_relationships(observations: DataFrame) -> DataFrame:
    """F4. Totals over the range. Attributes stay out so that no edge splits its totals."""
    summed = [m for m in MEASURES if m not in ("confidence", "duration_max")]
    return window_relationships(observations).groupBy(*EDGE).agg(
        F.max("confidence").alias("confidence"),
        *[F.sum(m).alias(m) for m in summed],
        F.max("duration_max").alias("duration_max"),
    )


ENTITY = ["entity_type", "entity_id", "entity_id_attrs", "scope", "descriptive", "source_tables"]


def entity_snapshots(entities: DataFrame, bucket: str | None = None) -> DataFrame:
    """F5. Entities over the range, or per window with `bucket="window"`.

    Descriptive attributes and sources are part of the key: a maximum over them
    would report one window's value for an entity that changed meanwhile.
    """
    if bucket == "window":
        return entities.groupBy("window_start", "window_end", *ENTITY).agg(
            F.max("fresh_until").alias("fresh_until")
        )
    return entities.groupBy(*ENTITY).agg(
        F.min("observed_at").alias("first_observed_at"),
        F.max("observed_at").alias("latest_observed_at"),
        F.max("fresh_until").alias("fresh_until"),
    )


def paired_edges(observations: DataFrame) -> DataFrame:
    """F6. Totals of the edges which come from span pairs only."""
    return (
        observations.where(
            (F.col("src_type") == "service")
            & (F.col("dst_type") == "service")
            & (F.col("rel_type") == "calls")
            & (F.col("provenance") == "trace")
            & (F.col("confidence") == 1.0)
        )
        .groupBy(*EDGE)
        .agg(
            F.sum("request_count").alias("request_count"),
            F.sum("error_count").alias("error_count"),
        )
    )


def virtual_edges(observations: DataFrame) -> DataFrame:
    """F7. Edges to peers which emit no spans."""
    return (
        observations.where(
            (F.col("rel_type") == "calls")
            & (F.col("provenance") == "trace")
            & (F.col("confidence") < 1.0)
        )
        .groupBy("src_id", "dst_id")
        .agg(
            F.max("confidence").alias("confidence"),
            F.sum("request_count").alias("request_count"),
            F.sum("unmatched_count").alias("unmatched_count"),
        )
    )


def client_minutes(spans: DataFrame) -> DataFrame:
    """F8. Client spans per minute."""
    minute = W.floor_div(W.floor_to("ts_ns", 60 * SECOND), SECOND)
    return clients(spans).groupBy(minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("client_spans")
    )


def entity_coverage(entities: DataFrame) -> DataFrame:
    """F9. Distinct entities, observations and scoped observations per type."""
    per_id = entities.groupBy("entity_type", "entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("scope").alias("scoped")
    )
    return per_id.groupBy("entity_type").agg(
        F.count("entity_id").alias("distinct_entity_count"),
        F.sum("n").alias("observation_count"),
        F.sum("scoped").alias("scoped_observation_count"),
    )


def relationship_coverage(observations: DataFrame) -> DataFrame:
    """F10. Distinct edges and observations per relationship type."""
    per_edge = observations.groupBy(*EDGE).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("unmatched_count").alias("u"),
        F.max("duration_max").alias("d"),
    )
    return per_edge.groupBy("rel_type").agg(
        F.count(F.lit(1)).alias("distinct_relationship_count"),
        F.sum("n").alias("observation_count"),
        F.max("u").alias("max_window_unmatched_count"),
        F.max("d").alias("max_request_duration"),
    )


# Columns which make a graph surface current.
SURFACE_COLUMNS = {
    "entity_scope_queryable": ("entities", ("scoped_observation_count",)),
    "table_entity_declarations_queryable": (
        "declarations", ("table_name", "entity_declarations"),
    ),
    "relationship_unmatched_count_queryable": (
        "relationships", ("max_window_unmatched_count",),
    ),
    "relationship_duration_max_queryable": ("relationships", ("max_request_duration",)),
}


def graph_status(
    entities: DataFrame, relationships: DataFrame, declarations: DataFrame | None = None
) -> DataFrame:
    """F11. Status of a graph from its coverage tables, with the surface flags."""
    counted = entities.agg(
        F.coalesce(F.sum("distinct_entity_count"), F.lit(0)).alias("e"),
        F.lit(0).cast("bigint").alias("r"),
        F.lit(0).cast("bigint").alias("o"),
    ).unionByName(
        relationships.agg(
            F.lit(0).cast("bigint").alias("e"),
            F.coalesce(F.sum("distinct_relationship_count"), F.lit(0)).alias("r"),
            F.coalesce(F.sum("observation_count"), F.lit(0)).alias("o"),
        )
    )
    total = counted.agg(
        F.sum("e").alias("distinct_entity_count"),
        F.sum("r").alias("distinct_relationship_count"),
        F.sum("o").alias("relationship_observation_count"),
    )
    tables = {"entities": entities, "relationships": relationships, "declarations": declarations}
    flags = []
    for flag, (table, needed) in SURFACE_COLUMNS.items():
        columns = tables[table].columns if tables[table] is not None else []
        flags.append(F.lit(all(c in columns for c in needed)).alias(flag))
    return total.select(
        F.when(F.col("distinct_relationship_count") > 0, "relational")
        .when(F.col("distinct_entity_count") > 0, "entity-only")
        .otherwise("empty")
        .alias("status"),
        "distinct_entity_count",
        "distinct_relationship_count",
        "relationship_observation_count",
        *flags,
    )


def unique_winner(edges: DataFrame, by: str = "src_id") -> DataFrame:
    """F32. The edge with strictly most errors per caller; a tie has no winner."""
    levels = edges.groupBy(by, "error_count").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("dst_id", "request_count")).alias("edge"),
    )
    top = levels.groupBy(by).agg(F.max(F.struct("error_count", "n", "edge")).alias("t"))
    single = F.col("t.n") == 1
    return top.select(
        by,
        F.when(single, F.col("t.edge.dst_id")).alias("winner"),
        F.when(single, F.col("t.edge.request_count")).alias("request_count"),
        F.when(single, F.col("t.error_count")).alias("error_count"),
    )


def call_gaps(
    spans: DataFrame,
    window: tuple[int, int] | None = None,
    operations: list[str] | None = None,
) -> DataFrame:
    """E4. Start gap of every client-server pair whose client operation is allowed, no time bound."""
    left = clients(spans, window)
    if operations:
        left = left.where(F.col("span_name").isin(*operations))
    right = servers(spans).select("trace_id", LINK, "service_name", "ts_ns")
    return (
        left.select("trace_id", LINK, "service_name", "ts_ns")
        .alias("c")
        .join(right.alias("s"), _child())
        .select(
            F.col("c.service_name").alias("src_id"),
            F.col("s.service_name").alias("dst_id"),
            F.col("c.ts_ns").alias("client_ns"),
            (F.col("s.ts_ns") - F.col("c.ts_ns")).alias("gap_ns"),
        )
    )


def sole_server_gaps(
    spans: DataFrame, period: Column, operations: list[str] | None = None
) -> DataFrame:
    """E5. Start gap of clients with exactly one server of a destination in their own period."""
    tagged = spans.withColumn("period", period).where("period is not null")
    left = clients(tagged)
    if operations:
        left = left.where(F.col("span_name").isin(*operations))
    right = servers(tagged).select(
        "trace_id", LINK, "service_name", "ts_ns", "period", "span_name"
    )
    pairs = (
        left.select("trace_id", LINK, "span_id", "service_name", "ts_ns", "period", "span_name")
        .alias("c")
        .join(right.alias("s"), _child() & (F.col("c.period") == F.col("s.period")))
    )
    # The link is a key too: where the join found its rows in place, so does this aggregate.
    keys = [
        F.col("c.trace_id").alias("trace_id"),
        F.col(f"c.{LINK}").alias(LINK),
        F.col("c.span_id").alias("span_id"),
        F.col("c.ts_ns").alias("client_ns"),
        F.col("c.period").alias("period"),
        F.col("c.service_name").alias("src_id"),
        F.col("s.service_name").alias("dst_id"),
    ]
    return (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("s.ts_ns").alias("server_ns"))
        .where("n = 1")
        .select(
            "trace_id", "span_id", "period", "src_id", "dst_id", "client_ns",
            (F.col("server_ns") - F.col("client_ns")).alias("gap_ns"),
        )
    )


def causal_traces(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """E6. Trace ids that carry a case's evidence.

    `targets` has case_id, service, edge_source, edge_destination. A directed
    edge needs a client of the source and a server child of the destination in
    one trace; otherwise any span of the service counts. Traces fold per edge and service;
    only cases that name several of them fold again.
    """
    rows = targets.select("case_id", "service", "edge_source", "edge_destination").distinct()
    several = rows.groupBy("case_id").count().where("count > 1").select("case_id")
    pairs = (
        clients(spans)
        .select("trace_id", LINK, F.col("service_name").alias("edge_source"))
        .alias("c")
        .join(
            servers(spans)
            .select("trace_id", LINK, F.col("service_name").alias("edge_destination"))
            .alias("s"),
            _child(),
        )
        .select(F.col("c.trace_id").alias("trace_id"), "edge_source", "edge_destination")
        .distinct()
    )
    present = spans.select("trace_id", F.col("service_name").alias("service")).distinct()

    def hits(cases: DataFrame) -> DataFrame:
        by_edge = pairs.join(cases, ["edge_source", "edge_destination"])
        by_service = present.join(cases.where("edge_source is null"), "service")
        return by_edge.select("case_id", "trace_id").unionByName(by_service.select("case_id", "trace_id"))

    single = hits(rows.join(several, "case_id", "left_anti"))
    return single.unionByName(hits(rows.join(several, "case_id", "left_semi")).distinct())


def compare_topology(derived: DataFrame, reference: DataFrame) -> DataFrame:
    """E7. Derived calls against a reference topology: found, missing or extra."""
    keys = ["src_id", "dst_id"]
    left = derived.select(*keys).distinct().withColumn("derived", F.lit(True))
    right = reference.select(*keys).distinct().withColumn("reference", F.lit(True))
    return left.join(right, keys, "full_outer").select(
        *keys,
        F.when(F.col("derived") & F.col("reference"), "found")
        .when(F.col("reference"), "missing")
        .otherwise("extra")
        .alias("status"),
    )


def typed_calls(
    entities: DataFrame,
    edges: DataFrame,
    relation: str = "calls",
    service_type: str = "apm.service",
) -> DataFrame:
    """E8. Calls between service entities, by name."""
    named = entities.where(F.col("type") == service_type).select("id", "name")
    return (
        edges.where(F.col("relation") == relation)
        .join(named.toDF("src", "src_id"), "src")
        .join(named.toDF("dst", "dst_id"), "dst")
        .select("src_id", "dst_id")
        .distinct()
    )


def distinct_edges(observations: DataFrame) -> DataFrame:
    """D10. Edge identities across all windows."""
    return observations.select(*EDGE).distinct()


def two_hop_paths(observations: DataFrame, window: tuple[int, int]) -> DataFrame:
    """E13. Two-hop reach: per source, distinct middles and paths over them.

    The paths through a middle are counted from its out-degree; the pairs of a
    hub are never written out.
    """
    inside = observations.where(W.half_open("observed_at", *window))
    edges = inside.select("src_id", "dst_id").distinct()
    degree = edges.groupBy(F.col("src_id").alias("dst_id")).agg(
        F.count(F.lit(1)).alias("onward")
    )
    return (
        edges.join(degree, "dst_id")
        .groupBy("src_id")
        .agg(
            F.count(F.lit(1)).alias("middles"),
            F.sum("onward").alias("paths"),
        )
    )


def two_hop_from(observations: DataFrame, window: tuple[int, int], source: str) -> DataFrame:
    """E13. Entities two calls away from one source."""
    inside = observations.where(W.half_open("observed_at", *window))
    edges = inside.select("src_id", "dst_id").distinct()
    first = edges.where(F.col("src_id") == source).select(F.col("dst_id").alias("middle"))
    return (
        first.join(edges, F.col("middle") == F.col("src_id"))
        .select("dst_id")
        .distinct()
    )


def entity_telemetry(entities: DataFrame, edges: DataFrame, telemetry: DataFrame) -> DataFrame:
    """E14. Entities with their edge ends and the rows of the tables that witness them.

    Each side is reduced to one row per entity before the join.
    """
    ends = (
        edges.select(F.col("src_type").alias("entity_type"), F.col("src_id").alias("entity_id"),
                     F.lit(1).alias("out"), F.lit(0).alias("in"))
        .unionByName(
            edges.select(F.col("dst_type").alias("entity_type"),
                         F.col("dst_id").alias("entity_id"),
                         F.lit(0).alias("out"), F.lit(1).alias("in"))
        )
        .groupBy("entity_type", "entity_id")
        .agg(F.sum("out").alias("outgoing"), F.sum("in").alias("incoming"))
    )
    rows = telemetry.groupBy("source_table", "entity_id").agg(
        F.count(F.lit(1)).alias("telemetry_rows")
    )
    named = entities.select("entity_type", "entity_id", "source_table").distinct()
    return named.join(ends, ["entity_type", "entity_id"]).join(rows, ["source_table", "entity_id"])


def correlate_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """E15. Log records with the span they were written in.

    The key is the span identity, which is unique, so every log record gives at
    most one row however large its trace is.
    """
    own = spans.select(
        "trace_id", "span_id", F.col("service_name").alias("span_service"), "status_code"
    )
    return logs.join(own, ["trace_id", "span_id"])


def trace_signal_counts(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """E15. Log and span counts of traces seen in both signals, without pairing them."""
    left = logs.groupBy("trace_id").agg(F.count(F.lit(1)).alias("log_records"))
    right = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("status_code") == ERROR).alias("error_spans"),
    )
    return left.join(right, "trace_id")
