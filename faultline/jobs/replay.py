"""Source audit and replay: archive files to canonical tables, with a gate table.

Reads an archive (wide, CSV or node layout) once per signal, writes canonical tables, and compares
the stored copy with the source. Everything between files and gates is one
distributed plan per table; nothing but the gate rows is small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators import audit as A
from faultline.operators import callgraph as G
from faultline.operators import collapse as C
from faultline.operators import evidence as E
from faultline.operators import surface as S
from faultline.session import configure, cut_lineage
from faultline.sources import csv_archive, node_archive, sinks, wide_archive

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Case:
    """Contiguous half-open windows of a case, in epoch seconds."""

    normal_start: int
    boundary: int
    abnormal_end: int


@dataclass(frozen=True)
class Archive:
    """File paths of the signals; every list holds both periods.

    `attributes` names the attribute columns; without it the schemas of all files are merged.
    """

    gauges: list[str]
    sums: list[str]
    histograms: list[str]
    logs: list[str]
    traces: list[str]
    attributes: list[str] | None = None


@dataclass(frozen=True)
class CsvArchive:
    """Files of the bank, market or telecom layout: one application file, others, logs and spans."""

    layout: str
    application: str
    others: list[str]
    logs: list[str]
    traces: list[str]


@dataclass(frozen=True)
class NodeArchive:
    """Files of the node layout; alerts and events are logs of their own tables."""

    metrics: str
    logs: str
    events: str
    alerts: str
    traces: str


@dataclass(frozen=True)
class Mechanism:
    """What a case must show of its fault.

    The metric's samples at or above the threshold after the boundary, none before; and a span of the
    service, or a call from `edge[0]` to `edge[1]`, in a trace that a sample of `sample` traces and a
    search by service reach.
    """

    metric: str
    threshold: float
    service: str
    edge: tuple[str, str] | None = None
    sample: int = 20


@dataclass(frozen=True)
class Signals:
    """Source rows as they are stored, each written once: every gate looks at them."""

    samples: DataFrame
    logs: DataFrame
    spans: DataFrame


SPAN = ["trace_id", "span_id", "parent_span_id", "service_name", "span_kind", "status_code", "span_name", "ts_ns", "end_ns"]


def _log_rows(rows: DataFrame) -> DataFrame:
    return rows.select("ts_ns", "message", N.labels_key(N.stream_labels("labels", "log_table")).alias("labels_key"))


def _sample_rows(samples: DataFrame) -> DataFrame:
    """Samples of the CSV and node readers; a repeated observation stays as it is."""
    return samples.select("metric", N.labels_key("labels").alias("labels_key"), (F.col("ts_ms") * 1_000_000).alias("ts_ns"), "value")


def projected_samples(spark: SparkSession, archive: Archive) -> DataFrame:
    """All metric files as samples per millisecond, last observation kept."""
    order = wide_archive.SOURCE_ORDER
    columns = ["metric", "ts_ns", "value", "labels", *order]
    numbers = [
        wide_archive.point_labels(wide_archive.read_numbers(spark, paths, kind, archive.attributes)).select(*columns)
        for kind, paths in (("gauge", archive.gauges), ("sum", archive.sums))
    ]
    points = wide_archive.point_labels(wide_archive.read_histograms(spark, archive.histograms, archive.attributes))
    fanned = C.histogram_samples(points).select(*columns)
    keyed = numbers[0].unionByName(numbers[1]).unionByName(fanned).select(
        N.fold_metric_name("metric").alias("metric"),
        N.labels_key("labels").alias("labels_key"),
        (W.floor_div("ts_ns", 1_000_000) * 1_000_000).alias("ts_ns"),
        "value",
        *order,
    )
    return C.last_observation(keyed, ["metric", "labels_key", "ts_ns"], "value", order).select(
        "metric", "labels_key", "ts_ns", "value"
    )


DIMENSIONS = ["service_name", "span_kind", "status_code"]


def _code(column: str, name_of, count: int):
    """The number of an enum's name; none for a name outside of the protocol."""
    names = F.array(*[name_of(F.lit(i)) for i in range(count)])
    return F.nullif(F.array_position(names, F.col(column)), F.lit(0)) - 1


def _sizes(signals: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("signal"), "row_count")
        for name, rows in signals.items()])


def _agreement(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return A.count_agreement(expected, stored, keys).agg(F.bool_and("match").alias("passed"))


def _names(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths).select(F.col("metric").cast("string").alias("metric"))


def _with_labels(samples: DataFrame) -> DataFrame:
    """Samples with their labels as a map and milliseconds, as the query surface takes them."""
    return samples.select(
        "metric", F.map_from_entries(F.from_json("labels_key", "array<struct<key:string,value:string>>")).alias("labels"),
        W.floor_div("ts_ns", 1_000_000).alias("ts_ms"),
    )


def wide_signals(spark: SparkSession, archive: Archive) -> Signals:
    return Signals(
        cut_lineage(projected_samples(spark, archive), "samples"),
        cut_lineage(_log_rows(wide_archive.read_logs(spark, archive.logs, archive.attributes)), "logs"),
        cut_lineage(wide_archive.read_spans(spark, archive.traces, archive.attributes).select(*SPAN), "spans"),
    )


def csv_signals(spark: SparkSession, archive: CsvArchive, window: tuple[int, int] | None) -> Signals:
    """A5 to A9. `window` includes both ends, in seconds."""
    if archive.layout == "bank":
        samples = csv_archive.read_bank_metrics(spark, archive.application, archive.others, window)
    elif archive.layout == "market":
        samples = csv_archive.read_market_metrics(spark, archive.application, archive.others, window)
    else:
        samples = csv_archive.read_telecom_metrics(spark, archive.application, archive.others, window)
    logs = csv_archive.read_csv_logs(spark, archive.logs, window, with_source=archive.layout == "market")
    spans = csv_archive.read_csv_spans(spark, archive.traces, archive.layout, window)
    return Signals(
        cut_lineage(_sample_rows(samples), "samples"), cut_lineage(_log_rows(logs), "logs"),
        cut_lineage(spans.select(*SPAN), "spans"),
    )


def node_signals(spark: SparkSession, archive: NodeArchive, window: tuple[int, int] | None) -> Signals:
    """A10 to A14. `window` is half-open, in seconds."""
    inside = None if window is None else W.half_open("ts_ns", window[0] * SECOND, window[1] * SECOND)
    logs = [
        read(spark, path) for read, path in (
            (node_archive.read_container_logs, archive.logs), (node_archive.read_events, archive.events),
            (node_archive.read_alerts, archive.alerts))
    ]
    rows = reduce(DataFrame.unionByName, [_log_rows(one) for one in logs])
    spans = node_archive.read_json_spans(spark, archive.traces).select(*SPAN)
    return Signals(
        cut_lineage(_sample_rows(node_archive.read_node_metrics(spark, archive.metrics, window)), "samples"),
        *[cut_lineage(d if inside is None else d.where(inside), name) for d, name in ((rows, "logs"), (spans, "spans"))],
    )


def store_signals(spark: SparkSession, signals: Signals, root: str) -> Signals:
    """Writes the canonical tables below `root` and opens them."""
    for signal, rows in (("metrics", signals.samples), ("logs", signals.logs), ("traces", signals.spans)):
        sinks.write_telemetry(rows, root, signal)

    def opened(signal: str, like: DataFrame) -> DataFrame:
        # A signal without rows has no folder.
        if like.isEmpty():
            return like
        return sinks.read_telemetry(spark, root, signal).select(*like.columns)

    return Signals(opened("metrics", signals.samples), opened("logs", signals.logs), opened("traces", signals.spans))


def copy_gates(signals: Signals, stored: Signals) -> dict[str, DataFrame]:
    """The stored tables hold what the source has."""
    rows_of = {"metrics": signals.samples, "logs": signals.logs, "traces": signals.spans}
    kept = {"metrics": stored.samples, "logs": stored.logs, "traces": stored.spans}
    return {
        "stored_rows_agree": _agreement(_sizes(rows_of), _sizes(kept), ["signal"]),
        "span_counts_agree": _agreement(
            A.group_counts(signals.spans, DIMENSIONS), A.group_counts(stored.spans, DIMENSIONS), ["dimension", "value"]
        ),
        "metrics_equal": A.multiset_difference(
            signals.samples, stored.samples, ["metric", "labels_key", "ts_ns", "value"]).select("equal"),
        "logs_present": A.presence_difference(
            signals.logs, stored.logs, ["labels_key", "ts_ns", "message"]).select("equal"),
        "spans_equal": A.multiset_difference(signals.spans, stored.spans, SPAN).select("equal"),
    }


def mechanism_gates(signals: Signals, stored: Signals, case: Case, mechanism: Mechanism) -> dict[str, DataFrame]:
    """F24, H4 and I6 on the stored tables: the fault can be seen, sampled and found.

    Facts must hold in the source and agree with those of the stored samples.
    """
    keys = ["metric", "labels_key"]

    def facts(samples: DataFrame) -> DataFrame:
        rows = samples.where(F.col("metric") == mechanism.metric)
        period = W.period_of("ts_ns", case.normal_start * SECOND, case.boundary * SECOND, case.abnormal_end * SECOND)
        return E.threshold_facts(rows, keys, period, "value", mechanism.threshold, empty_as_zero=False)

    source_facts, stored_facts = facts(signals.samples), facts(stored.samples)
    proven = source_facts.agg(F.coalesce(F.bool_or(E.transition_proven()), F.lit(False)).alias("passed"))
    edge = mechanism.edge or (None, None)
    targets = signals.spans.sparkSession.createDataFrame(
        [("case", mechanism.service, *edge)], "case_id string, service string, edge_source string, edge_destination string")
    causal = G.causal_traces(signals.spans, targets).select("trace_id")
    of_service = F.col("service_name") == mechanism.service
    expected = signals.spans.where(of_service).select("trace_id").distinct()
    returned = stored.spans.where(of_service).select("trace_id").distinct()
    sample = S.causal_first_sample(stored.spans.select("trace_id").distinct(), causal, mechanism.sample)
    return {
        "transition_proven": proven,
        "transition_facts_stored": A.multiset_difference(
            source_facts, stored_facts, source_facts.columns).select("equal"),
        "causal_trace_in_sample": sample.agg(F.coalesce(F.bool_or("causal"), F.lit(False)).alias("passed")),
        "causal_trace_searchable": A.reachability(returned, expected, causal, "trace_id").select("reachable"),
    }


def _period_gate(signals: Signals, start: int, end: int) -> DataFrame:
    times = (
        signals.samples.select(F.lit("metrics").alias("signal"), "ts_ns")
        .unionByName(signals.logs.select(F.lit("logs").alias("signal"), "ts_ns"))
        .unionByName(signals.spans.select(F.lit("traces").alias("signal"), "ts_ns"))
    )
    return A.signal_periods(times, ["signal"], "ts_ns", start, end).select("all_rows_in_declared_window")


def replay_csv(spark: SparkSession, archive: CsvArchive, window: tuple[int, int], root: str) -> DataFrame:
    """Replays one window of a CSV archive, both ends included, and returns the gates.

    These spans have neither kind nor service, so there is no graph to compare.
    """
    configure(spark)
    signals = csv_signals(spark, archive, window)
    stored = store_signals(spark, signals, root)
    inside = _period_gate(signals, window[0] * SECOND, (window[1] + 1) * SECOND)
    return A.gate_table({"source_rows_in_declared_window": inside, **copy_gates(signals, stored)})


def replay_nodes(
    spark: SparkSession, archive: NodeArchive, window: tuple[int, int], root: str
) -> DataFrame:
    """Replays one half-open window of a node archive and returns the gates."""
    configure(spark)
    signals = node_signals(spark, archive, window)
    stored = store_signals(spark, signals, root)
    coded = signals.spans.withColumns({
        "kind": _code("span_kind", N.span_kind_name, 6), "status": _code("status_code", N.status_name, 3)})
    return A.gate_table({
        "source_rows_in_declared_window": _period_gate(signals, window[0] * SECOND, window[1] * SECOND),
        **copy_gates(signals, stored),
        "raw_and_graph_edges_equal": A.edge_sets_equal(
            G.call_edges(G.span_pairs(signals.spans)), G.paired_edges(G.edge_observations(stored.spans))).select("exact"),
    }, [A.span_gates(coded, allow_zero=True)])


def replay(
    spark: SparkSession, archive: Archive, case: Case, root: str, mechanism: Mechanism | None = None
) -> DataFrame:
    """Replays a wide archive and returns the gates (I10), with `mechanism` also those of its fault."""
    configure(spark)
    signals = wide_signals(spark, archive)
    stored = store_signals(spark, signals, root)
    samples, spans = signals.samples, signals.spans
    # The graph is built from the stored spans, in bins of one minute.
    bins = G.edge_observations(stored.spans).withColumn("ts_ns", F.col("observed_at") * SECOND)
    sinks.write_telemetry(bins, root, "relationships")
    graph = sinks.read_telemetry(spark, root, "relationships")
    coded = spans.withColumns({
        "kind": _code("span_kind", N.span_kind_name, 6), "status": _code("status_code", N.status_name, 3)})
    boundary = spark.createDataFrame([("case", case.boundary)], "case_id string, boundary long")
    gates = {
        "source_rows_in_declared_window": _period_gate(signals, case.normal_start * SECOND, case.abnormal_end * SECOND),
        **copy_gates(signals, stored),
        "window_split_supported": E.boundary_split(spans, boundary).select("split_supported"),
        "no_unexpected_metrics": A.unexpected_tables(
            stored.samples.select(F.col("metric").alias("table_name")),
            *[_names(spark, paths) for paths in ([*archive.gauges, *archive.sums], archive.histograms)], [],
        ).agg((F.count(F.lit(1)) == 0).alias("passed")),
        "no_generated_labels": A.generated_labels(
            _with_labels(stored.samples), _with_labels(samples), "labels"
        ).agg((F.count(F.lit(1)) == 0).alias("passed")),
        "queries_answered": S.surface_check(
            _with_labels(samples), _with_labels(stored.samples),
            (case.normal_start * 1000, case.abnormal_end * 1000),
        ).agg(F.bool_and(F.col("labels_pass") & F.col("values_pass") & F.col("series_pass")
                         & F.col("instant_pass") & F.col("range_pass")).alias("passed")),
        "raw_and_graph_edges_equal": A.edge_sets_equal(
            G.call_edges(G.span_pairs(spans)), G.paired_edges(graph)
        ).select("exact"),
    }
    if mechanism is not None:
        gates |= mechanism_gates(signals, stored, case, mechanism)
    # Identity, names and ids are one look at the spans.
    return A.gate_table(gates, [A.span_gates(coded)])
