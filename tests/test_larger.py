"""Queries on tables that are larger than, or lie otherwise than, the driver's."""

import json
import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultline.jobs.evaluation import evaluated_runs
from faultline.operators import callgraph, surface
from faultline.plans import graph, statistics, views
from faultline.session import DEALT_ONCE, SHUFFLES_GO, configure, cut_lineage, settings
from faultline.sources import case_files, sinks
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of the driver's tables in which some are replaced."""

    def build(**changed):
        folder = tmp_path / "tables"
        shutil.copytree(SF, folder, copy_function=os.symlink)
        for name, change in changed.items():
            path = folder / f"{name}.parquet"
            os.unlink(path)
            rows = change(spark.read.parquet(f"{SF}/{name}.parquet")).toPandas()
            rows.to_parquet(path, coerce_timestamps="us")
        return str(folder)

    return build


def difference(spark, folder, name):
    return oracle.compare(entry.queries()[name](spark, folder), oracle.connect(folder), entry.oracle_sql()[name])


def repeated(rows, times, **shifts):
    """Copies with shifted keys."""
    copies = rows.crossJoin(rows.sparkSession.range(times).select(F.col("id").alias("_copy")))
    return copies.select(*[
        (F.col(c) + shifts[c] * F.col("_copy")).cast(rows.schema[c].dataType).alias(c) if c in shifts else c
        for c in rows.columns
    ])


def test_families_larger_than_declared_follow_the_formula(spark, tables):
    # Some 600 suppliers of one nation; their family declares 500.
    folder = tables(supplier=lambda s: repeated(s, 60, s_suppkey=1000).withColumn(
        "s_nationkey", F.lit(3)).withColumn("s_suppkey", F.col("s_suppkey").cast("bigint")))
    assert difference(spark, folder, "g3_holm_over_suppliers") is None


def test_gauges_of_other_points_at_the_same_time_stay_out(spark, tables):
    # All events of an hour share their time, so an even and an odd point meet.
    folder = tables(events=lambda e: e.withColumn("ts", F.date_trunc("hour", F.col("ts")).cast(e.schema["ts"].dataType)))
    assert difference(spark, folder, "a1_projected_series") is None


def test_buckets_of_stored_spans_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(sinks, "SPANS_PER_BUCKET", 200)
    t = views.Tables(spark, SF)
    stored = graph.StoredSpans(t).spans
    per_bucket = stored.groupBy(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c", 1).alias("b")).count()
    n, most = per_bucket.agg(F.count("b"), F.max("count")).first()
    assert n >= t.spans.count() / 200 * 0.9 > 8 and most < 400


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_event_is_parsed_once(spark):
    text = optimized(entry.queries()["a12_read_events"](spark, SF))
    assert text.count("from_json") == 1 and text.count("regexp_extract(") == 3


def test_words_of_a_search_are_settled_before_the_rows(spark):
    found = entry.queries()["h2_catalog_search"](spark, SF)
    assert "translate(" not in optimized(found) and "exists(" not in optimized(found)
    with pytest.raises(ValueError):
        surface.search_catalog(found, "of the")


def test_records_of_runs_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "records")
    statistics.lineitem_records(views.Tables(spark, SF)).limit(50).write.json(path)
    runs = case_files.read_runs(spark, path)
    cases = runs.select("case_id").distinct().select(
        "case_id", *[F.lit(None).cast("string").alias(f"true_{c}") for c in (
            "scope", "component", "edge_source", "edge_destination", "fault_category")],
        *[F.array().cast("array<string>").alias(c) for c in (
            "accepted_mechanisms", "allowed_operations", "identities")],
    ).localCheckpoint()
    evaluated = evaluated_runs(runs, cases, 10**6)
    assert evaluated.count() == 50
    assert not any(".json" in f for f in evaluated.inputFiles())


def test_equal_lines_of_a_run_are_calls_of_their_own(spark, tables):
    folder = tables(lineitem=lambda rows: rows.unionByName(rows))
    assert difference(spark, folder, "a18_records_to_holm") is None
    assert entry.queries()["a18_records_to_holm"](spark, folder).count() > 0


def test_runs_are_parted_from_their_calls(spark, tmp_path):
    call = {"query_id": "a", "tool_name": "execute_sql", "input": {"sql": "SELECT 1"}, "output": {"query_id": "a"},
            "base_tables": ["logs"], "database_load": {"rows_returned": 3}}
    cited = {"evidence": [{"query_id": "a", "claim": "slow"}, {"query_id": None}]}
    runs = [
        {"tool_calls": [call, call | {"query_id": "b", "error": "timeout"}, {"query_id": None}, call], "diagnosis": cited},
        {"tool_calls": [], "diagnosis": cited}, {"tool_calls": [call]}, {"diagnosis": cited}, {},
    ]
    lines = [json.dumps({"cell_index": i, "visibility": "raw", "run": run}) for i, run in enumerate(runs)]
    (tmp_path / "runs.json").write_text("\n".join(lines))
    records = case_files.read_runs(spark, str(tmp_path / "runs.json"))
    parts, calls = case_files.parted_runs(records), case_files.run_calls(records)
    assert parts.count() == len(runs) and parts.schema["calls"].dataType.elementType.names == [
        "tool_name", "failed", "sql_text", "rows_returned"]
    counted, named = case_files.counted_calls(parts), case_files.named_calls(parts)
    assert sorted(counted.collect(), key=str) == sorted(calls.select(*counted.columns).collect(), key=str)
    assert sorted(named.collect(), key=str) == sorted(calls.where("run_id = 0 and query_id = 'a'").collect(), key=str)
    assert named.count() == 2


def test_records_of_runs_are_packed_and_dealt_once(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(statistics, "cut_lineage", lambda df, purpose: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df, purpose))
    monkeypatch.setattr(statistics, "work_dir", lambda _, purpose: str(tmp_path / purpose))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert entry.queries()["a18_records_to_holm"](spark, SF).count() > 0
        assert spark.conf.get(next(iter(SHUFFLES_GO))) == "false" and spark.conf.get(next(iter(DEALT_ONCE))) == "true"
    names = [f.name for f in (tmp_path / "records").glob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)
    # Runs and their cases by case, counts by run, and nothing by run and query id.
    assert 0 < plans[0].count("Exchange hashpartitioning") <= 5 and "hashpartitioning(run_id#" in plans[0]
    assert not re.search(r"Exchange hashpartitioning\(run_id#\d+, ", re.sub(r", \d+\), ENSURE", "), ENSURE", plans[0]))


def test_a_task_takes_few_compressed_bytes_unless_the_caller_says_more(spark):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    own, given = spark.newSession(), spark.newSession()
    for name in names:
        given.conf.set(name, "1m")
    assert [configure(own).conf.get(n) for n in names] == ["16m", "32m"]
    assert [configure(given).conf.get(n) for n in names] == ["1m", "1m"]


def test_traces_of_a_case_fold_before_they_meet_it(spark):
    t = views.Tables(spark, SF)
    targets = spark.createDataFrame(
        [("a", "svc1", None, None), ("a", "svc1", None, None), ("b", "svc1", None, None), ("b", "svc2", None, None),
         ("c", None, "svc1", "svc2"), ("d", None, "svc1", "svc2"), ("d", "svc1", None, None)],
        "case_id string, service string, edge_source string, edge_destination string")
    found = callgraph.causal_traces(t.spans, targets).localCheckpoint()
    assert found.count() == found.distinct().count()
    counts = {r[0]: r[1] for r in found.groupBy("case_id").count().collect()}
    spans = t.spans.select("trace_id", "service_name").distinct()
    assert counts["a"] == counts["d"] == spans.where("service_name = 'svc1'").count()
    assert counts["b"] == spans.where("service_name in ('svc1', 'svc2')").select("trace_id").distinct().count()
    # Cases with one target are not folded a second time.
    single = spark.createDataFrame([("a", "svc1", None, None)], targets.schema)
    plan = optimized(callgraph.causal_traces(t.spans, single))
    assert plan.startswith("Union")
