"""Physical plans: what must reach the scan, and what must never appear."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry  # noqa: F401  (puts the package on the path)
from faultline.plans import QUERIES as REGISTERED
from faultline.functions import windows as W
from faultline.operators import callgraph as G
from faultline.plans import views
from faultline.sources import sinks

SF = "/root/testdata/sf0.001"
# Streams and archive queries run jobs when they are built.
LAZY = [
    n for n in REGISTERED
    if not n.startswith(("a", "k")) and n not in ("f63_holm", "f73_family_tally")
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def plans(spark):
    """Plans of all queries as they are when no side is small enough to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    found = {name: plan(REGISTERED[name](spark, SF)) for name in LAZY}
    for key in keys:
        spark.conf.unset(key)
    return found


def test_no_query_crosses_tables_or_forces_a_broadcast(plans):
    """Every join has an equality to shuffle on."""
    unwanted = "CartesianProduct|BroadcastNestedLoopJoin|BroadcastExchange|BatchEvalPython"
    bad = {n: set(re.findall(unwanted, p)) for n, p in plans.items() if re.search(unwanted, p)}
    assert bad == {}


def test_only_the_overlap_rule_runs_in_python(plans):
    python = [n for n, p in plans.items() if re.search("Python|InPandas|ArrowEval", p)]
    assert python == ["d7_duplicate_incidents"]


def test_window_filter_reaches_the_scan(spark):
    text = plan(REGISTERED["c1_half_open_window"](spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "props" not in schema and "value" not in schema


def test_stored_spans_are_filtered_and_pruned(spark, tmp_path):
    t = views.Tables(spark, SF)
    sinks.write_telemetry(t.spans, str(tmp_path), "traces")
    stored = sinks.read_telemetry(spark, str(tmp_path), "traces")
    text = plan(G.call_edges(G.span_pairs(stored, views.WINDOW)))
    scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", text)
    assert len(scans) == 2
    for pushed, schema in scans:
        assert "GreaterThanOrEqual(ts_ns" in pushed and "EqualTo(span_kind" in pushed
        assert "peer" not in schema and "span_name" not in schema


@pytest.fixture
def span_table(spark, tmp_path):
    t = views.Tables(spark, SF)
    yield sinks.write_spans(t.spans, "stored_spans", str(tmp_path / "spans"), 8)
    spark.sql("DROP TABLE stored_spans")


def test_pairing_of_stored_spans_needs_no_exchange(span_table, no_broadcast):
    pairs = plan(G.span_pairs(span_table, views.WINDOW))
    assert "SortMergeJoin" in pairs and "Exchange" not in pairs
    assert "Exchange" not in plan(G.unpaired_clients(span_table, views.WINDOW))
    assert "Exchange" not in plan(G.sole_server_gaps(span_table, F.lit("p")))
    # Only the counts of the edges move.
    assert len(re.findall("Exchange hashpartitioning", plan(G.call_edges(G.span_pairs(span_table))))) == 1
    assert len(re.findall("Exchange hashpartitioning", plan(G.edge_observations(span_table, peer="peer")))) == 1


def test_stored_spans_open_in_another_catalog(spark, span_table, tmp_path, no_broadcast):
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in span_table.schema if f.name not in ("link_id", "date"))
    again = sinks.open_spans(spark, "opened_spans", str(tmp_path / "spans"), kinds, 8)
    assert again.count() == span_table.count() > 0
    assert "Exchange" not in plan(G.span_pairs(again))
    spark.sql("DROP TABLE opened_spans")


def test_stored_statistics_come_from_footers(spark, tmp_path):
    t = views.Tables(spark, SF)
    sinks.write_telemetry(t.spans, str(tmp_path), "traces")
    text = plan(sinks.stored_stats(spark, str(tmp_path)))
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), MIN\(ts_ns\), MAX\(ts_ns\)\]", text)
    assert spark.conf.get("spark.sql.sources.useV1SourceList").count("parquet") == 1


def test_one_changed_record_opens_one_bucket(spark, tmp_path):
    keys = ["k", "v"]
    source = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    changed = source.withColumn("v", F.when(F.col("k") == 77, "y").otherwise("x"))
    for rows, name in ((source, "a"), (changed, "b")):
        sinks.write_records(rows, str(tmp_path / name), keys, 64)
    left, right = sinks.changed_records(spark, str(tmp_path / "a"), str(tmp_path / "b"), keys)
    partitions = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(left)).group(1)
    assert "record_bucket" in partitions and 0 < left.count() < 2000
    # The old and the new record lie in one bucket each.
    stored = sinks.read_records(spark, str(tmp_path / "a"))
    assert 1 <= stored.join(left, keys).select("record_bucket").distinct().count() <= 2
    same = sinks.changed_records(spark, str(tmp_path / "a"), str(tmp_path / "a"), keys)
    assert all(side.count() == 0 for side in same)


def test_archive_samples_are_read_in_one_pass(spark):
    """The written samples are what remains of the source in the plan."""
    text = plan(REGISTERED["a10_read_node_metrics"](spark, SF))
    assert len(re.findall("FileScan", text)) == 1


def test_pairing_shuffles_each_side_once(spark, no_broadcast):
    text = plan(G.span_pairs(views.Tables(spark, SF).spans, views.WINDOW))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_unmatched_and_paired_edges_share_one_join(spark, no_broadcast):
    t = views.Tables(spark, SF)
    text = plan(G.edge_observations(t.spans, views.WINDOW, peer="peer"))
    assert len(re.findall(r"SortMergeJoin|ShuffledHashJoin", text)) == 1


def test_quotas_limit_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(REGISTERED["g4_quota_selection"](spark, SF))


def test_top_rows_are_taken_per_task(spark):
    assert "TakeOrderedAndProject" in plan(REGISTERED["h5_newest_rows"](spark, SF))


def test_floor_of_raw_time_is_integer(spark):
    df = spark.range(1).select(W.floor_div(F.lit(1_704_553_130_026_000_000), 1_000_000).alias("q"))
    assert df.first().q == 1_704_553_130_026
