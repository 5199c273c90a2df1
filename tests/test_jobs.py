"""The end-to-end jobs."""

import pytest
from pyspark.sql import functions as F

from faultline.jobs import replay as J
from faultline.jobs.report import measurement_report
from faultline.jobs.selection import select_cases
from faultline.plans import views
from tests.test_sources import BANK_APP, HISTOGRAM, KPI, NOON, NS, POINT, SPAN, TEXT, csv, parquet

START = 1_700_000_040  # a whole minute
CASE = J.Case(START, START + 120, START + 240)
LOG = {"time": NS, "service_name": TEXT, "message": TEXT}


def two_spans(at, period):
    """A call from the gate to the crane; ids differ between the periods."""
    trace, caller, callee = f"{7 + period:032x}", f"{17 + period:016x}", f"{27 + period:016x}"
    return [(at, trace, caller, "", "open", "Client", "gate", 7, "Unset", None),
            (at + 5, trace, callee, caller, "lift", "Server", "crane", 7, "Error", None)]


@pytest.fixture
def archive(tmp_path):
    def both(stem, kinds, rows):
        return [parquet(tmp_path / f"{p}_{stem}.parquet", kinds, *rows((START + i * 120 + 3) * J.SECOND, i))
                for i, p in enumerate(("normal", "abnormal"))]

    return J.Archive(
        gauges=both("tide", POINT, lambda at, _: [(at, "tide.level", v, "gauge", "north") for v in (1.0, 2.0)]),
        sums=both("tide_sum", POINT, lambda at, _: [(at, "tide.level", 5.0, "gauge", "north")]),
        histograms=both("lifts", HISTOGRAM, lambda at, _: [(at, "crane.lift", "crane", 2.0, 8.0, 1.0, 7.0, "south")]),
        logs=both("notes", LOG, lambda at, _: [(at, "gate", "open")] * 3),
        traces=both("calls", SPAN, two_spans),
    )


def test_replay_passes_its_gates(spark, archive, tmp_path):
    gates = {r.gate: r.passed for r in J.replay(spark, archive, CASE, str(tmp_path / "out")).collect()}
    assert all(gates.values()), gates
    stored = spark.read.parquet(str(tmp_path / "out" / "signal=metrics"))
    # Gauges and sums of one name and instant share a key; the sum comes last.
    values = sorted(r.value for r in stored.where("metric = 'tide_level'").collect())
    assert values == [5.0, 5.0]


def test_replay_fails_the_window_gate(spark, archive, tmp_path):
    late = J.Case(START, START + 120, START + 121)
    gates = {r.gate: r.passed for r in J.replay(spark, archive, late, str(tmp_path / "out")).collect()}
    assert not gates["source_rows_in_declared_window"] and not gates["all_passed"]
    assert gates["metrics_equal"]


def test_replay_sees_broken_kinds_and_split_minutes(spark, archive, tmp_path):
    inside = J.Case(START, START + 123, START + 240)  # the boundary is within a minute with calls on one side
    gates = {r.gate: r.passed for r in J.replay(spark, archive, inside, str(tmp_path / "a")).collect()}
    assert gates["window_split_supported"] and gates["all_passed"]
    row = two_spans((START + 3) * J.SECOND, 0)[0]
    twice = parquet(tmp_path / "normal_twice.parquet", SPAN, row, row)
    doubled = J.Archive(archive.gauges, archive.sums, archive.histograms, archive.logs, [*archive.traces[1:], twice])
    gates = {r.gate: r.passed for r in J.replay(spark, doubled, CASE, str(tmp_path / "b")).collect()}
    assert not gates["source_trace_identity_valid"] and gates["spans_equal"] and not gates["all_passed"]


def test_mechanism_gates(spark, archive, tmp_path):
    """The sum is 5 in both periods; the calls into the crane are the evidence."""
    seen = J.Mechanism("tide_level", 4.0, "crane", ("gate", "crane"))
    gates = {r.gate: r.passed for r in J.replay(spark, archive, CASE, str(tmp_path / "a"), seen).collect()}
    assert not gates["transition_proven"] and gates["transition_facts_stored"]
    assert gates["causal_trace_in_sample"] and gates["causal_trace_searchable"] and not gates["all_passed"]
    signals = J.wide_signals(spark, archive)
    at = (CASE.boundary + 5) * J.SECOND
    risen = signals.samples.where("metric = 'tide_level'").limit(1).select(
        "metric", "labels_key", F.explode(F.array(F.lit((START + 9) * J.SECOND), F.lit(at), F.lit(at + 1))).alias("ts_ns")
    ).withColumn("value", F.when(F.col("ts_ns") >= at, 50.0).otherwise(1.0))
    shown = J.Signals(risen, signals.logs, signals.spans)
    stored = J.store_signals(spark, shown, str(tmp_path / "b"))
    other = J.Mechanism("tide_level", 40.0, "nobody")
    found = {n: g.first()[0] for n, g in J.mechanism_gates(shown, stored, CASE, other).items()}
    assert found == {"transition_proven": True, "transition_facts_stored": True,
                     "causal_trace_in_sample": False, "causal_trace_searchable": False}


def test_replay_of_a_csv_archive(spark, tmp_path):
    app = csv(tmp_path / "metric_app.csv", BANK_APP, *[f"{NOON + i},7,6,5,4,Ferry" for i in range(4)])
    kpi = csv(tmp_path / "metric_container.csv", KPI, f"{NOON},Quay7,FuelLeft,3", f"{NOON + 1},Quay7,FuelLeft,3")
    log = csv(tmp_path / "log.csv", "log_id,timestamp,cmdb_id,log_name,value", f"1,{NOON},Quay7,gc,open", f"2,{NOON + 99},Quay7,gc,late")
    spans = csv(tmp_path / "trace.csv", "timestamp,cmdb_id,parent_id,span_id,trace_id,duration", f"{NOON * 1000},Quay7,,s1,t1,5")
    archive = J.CsvArchive("bank", app, [kpi], [log], [spans])
    gates = {r.gate: r.passed for r in J.replay_csv(spark, archive, (NOON, NOON + 3), str(tmp_path / "out")).collect()}
    assert all(gates.values()) and gates["metrics_equal"], gates
    stored = J.sinks.read_telemetry(spark, str(tmp_path / "out"), "metrics")
    assert stored.count() == 4 * 4 + 2
    assert J.sinks.read_telemetry(spark, str(tmp_path / "out"), "logs").count() == 1


def test_selection_fills_its_quotas_or_ends(spark):
    rows = [(f"c{i}", "s", "cpu" if i % 2 else "net", False, ["r"]) for i in range(12)]
    manifest = spark.createDataFrame(rows, "name string, system string, primary_kind string, hybrid boolean, root_services array<string>")
    audits = spark.createDataFrame([(f"c{i}", i > 3) for i in range(12)], "name string, passed boolean")
    without = spark.createDataFrame([("c5",)], "name string")
    kinds = {"cpu": "resource", "net": "network"}
    quotas = {("resource", "s"): 2, ("network", "s"): 3}
    chosen = select_cases(manifest, without, audits, kinds, ["s"], quotas, "seed").collect()
    assert [r.number for r in sorted(chosen, key=lambda r: (r.mechanism, r.rank))] == [1, 2, 3, 4, 5]
    assert not {"c5", "c0", "c1", "c2", "c3"} & {r.name for r in chosen}
    with pytest.raises(ValueError, match="quotas not met"):
        select_cases(manifest, without, audits, kinds, ["s"], {("resource", "s"): 9}, "seed")
    absent = spark.createDataFrame([("nobody",)], "name string")
    with pytest.raises(ValueError, match="absent from the manifest"):
        select_cases(manifest, absent, audits, kinds, ["s"], quotas, "seed")


def test_usage_tables_of_the_report(spark, tmp_path):
    t = views.Tables(spark, "/root/testdata/sf0.001")
    runs = t.runs.withColumn("cache_breakdown_complete", F.lit(True))
    rates = spark.createDataFrame([("USD", 1.0), ("CNY", 0.14)], "currency string, per_unit_usd double")
    tables = measurement_report(
        runs, t.case_table, "split", "raw", ["tool_calls"], 8, str(tmp_path / "r"), usd_rates=rates)
    spent = {(r.treatment, r.currency): r.spend for r in tables["spend"].collect()}
    assert spent and all(v > 0 for v in spent.values())
    known = tables["cost_status"].where("status = 'available'").agg(F.sum("estimated_cost")).first()[0]
    assert abs(tables["cost_totals"].agg(F.sum("known_total")).first()[0] - known) < 1e-9
    assert tables["usage"].agg(F.sum("output_tokens")).first()[0] == t.runs.agg(F.sum("output_tokens")).first()[0]


def test_report_tables(spark, tmp_path):
    t = views.Tables(spark, "/root/testdata/sf0.001")
    tables = measurement_report(
        t.runs, t.case_table, "split", "raw", ["rows_returned", "tool_calls"], 8, str(tmp_path / "r")
    )
    endpoints = tables["endpoints"].collect()
    assert {r.metric for r in endpoints} == {"rows_returned", "tool_calls"}
    assert all(r.holm_adjusted_p >= r.sign_test_p for r in endpoints if r.sign_test_p is not None)
    total = tables["capability"].agg(F.sum("runs")).first()[0]
    assert total == t.runs.count()
