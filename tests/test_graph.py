"""Call graph rules on hand-checked spans and observations."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.operators import audit as A
from faultline.operators import callgraph as G

S = 1_000_000_000
SPAN = (
    "trace_id string, span_id string, parent_span_id string, service_name string, "
    "span_kind string, status_code string, span_name string, ts_ns long, end_ns long"
)
CLIENT, SERVER, INTERNAL = "SPAN_KIND_CLIENT", "SPAN_KIND_SERVER", "SPAN_KIND_INTERNAL"
ERROR, UNSET = "STATUS_CODE_ERROR", "STATUS_CODE_UNSET"


def span(trace, ident, parent, service, kind, at, status=UNSET, name="op", length=1):
    return (trace, ident, parent, service, kind, status, name, int(at * S), int((at + length) * S))


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), SPAN)


def edges(df, **kw):
    found = G.call_edges(G.span_pairs(df, **kw)).collect()
    return {(r.src_id, r.dst_id): (r.request_count, r.error_count) for r in found}


def test_client_with_failed_server_child(spark):
    df = spans(
        spark,
        span("t", "c", "", "web", CLIENT, 1000),
        span("t", "s", "c", "api", SERVER, 1001, ERROR),
        span("t", "x", "wrong", "api", SERVER, 1001),
        span("t", "i", "c", "api", INTERNAL, 1001),
        span("u", "s2", "c", "api", SERVER, 1001),
    )
    assert edges(df) == {("web", "api"): (1, 1)}


def test_server_must_start_in_reach(spark):
    rows = [span("t", "c", "", "web", CLIENT, 10_000)]
    for i, shift in enumerate((-301, -300, 3600, 3601)):
        rows.append(span("t", f"s{i}", "c", f"d{shift}", SERVER, 10_000 + shift))
    assert set(edges(spans(spark, *rows))) == {("web", "d-300"), ("web", "d3600")}


def test_self_calls_count_only_for_the_caller_query(spark):
    df = spans(
        spark,
        span("t", "c", "", "web", CLIENT, 100),
        span("t", "s", "c", "web", SERVER, 101),
    )
    assert edges(df) == {}
    assert edges(df, exclude_self=False, caller="web") == {("web", "web"): (1, 0)}


def test_window_is_half_open_and_servers_may_lie_outside(spark):
    df = spans(
        spark,
        span("t", "a", "", "web", CLIENT, 100), span("t", "sa", "a", "api", SERVER, 250),
        span("t", "b", "", "web", CLIENT, 200), span("t", "sb", "b", "api", SERVER, 200),
    )
    assert edges(df, window=(100, 200)) == {("web", "api"): (1, 0)}


def test_minute_envelope(spark):
    low, high = W.minute_envelope(F.lit(121), F.lit(239))
    row = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (row.l, row.h) == (120, 240)
    low, high = W.minute_envelope(F.lit(120), F.lit(240))
    row = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (row.l, row.h) == (120, 240)


def test_observations_carry_virtual_peers(spark):
    df = spans(
        spark,
        span("t", "c", "", "web", CLIENT, 61), span("t", "s", "c", "api", SERVER, 62, length=3),
        span("t", "d", "", "web", CLIENT, 65),
    ).withColumn("peer", F.when(F.col("span_id") == "d", "db"))
    found = {r.dst_id: r for r in G.edge_observations(df, peer="peer").collect()}
    assert (found["api"].window_start, found["api"].confidence, found["api"].duration_max) == (
        60, 1.0, 3.0 * S)
    assert (found["db"].confidence, found["db"].unmatched_count, found["db"].duration_sum) == (
        0.5, 1, None)


OBSERVATION = (
    "window_start long, window_end long, observed_at long, src_type string, src_id string, "
    "dst_type string, dst_id string, rel_type string, provenance string, attributes string, "
    "confidence double, request_count long, unmatched_count long, error_count long, "
    "duration_sum double, duration_count long, duration_max double"
)


def observation(at, attributes, requests):
    return (at, at + 60, at, "service", "a", "service", "b", "calls", "trace", attributes, 1.0,
            requests, 0, 0, 1.0, 1, 1.0)


def test_range_totals_do_not_split_by_attributes(spark):
    df = spark.createDataFrame(
        [observation(0, "x", 5), observation(0, "x", 7), observation(0, "y", 6),
         observation(60, "y", 4)], OBSERVATION)
    assert G.window_relationships(df, "attributes").count() == 3
    total = G.range_relationships(df).collect()
    assert [(r.request_count, r.duration_sum) for r in total] == [(11, 2.0)]


EDGE = (
    "src_type string, src_id string, dst_type string, dst_id string, rel_type string, "
    "provenance string, request_count long, error_count long"
)


def edge_frame(spark, *rows):
    return spark.createDataFrame(
        [("service", s, "service", d, "calls", "trace", n, e) for s, d, n, e in rows], EDGE)


@pytest.mark.parametrize("left, right, exact", [
    ([("a", "b", 2, 1)], [("a", "b", 2, 1)], True),
    ([("a", "b", 2, 1)], [("a", "b", 2, 0)], False),
    ([("a", "b", 2, 1)], [("a", "b", 2, 1), ("a", "c", 1, 0)], False),
    ([("a", "b", 2, 1), ("a", "b", 2, 1)], [("a", "b", 2, 1)], None),
    ([("a", "b", 2, None)], [("a", "b", 2, None)], None),
    ([], [("a", "b", 2, 1)], None),
    ([], [], None),
])
def test_edge_sets(spark, left, right, exact):
    row = A.edge_sets_equal(edge_frame(spark, *left), edge_frame(spark, *right)).first()
    assert row.exact is exact
    cut = A.edge_sets_equal(
        edge_frame(spark, *left), edge_frame(spark, *right), left_truncated=True).first()
    assert cut.exact is None


def test_winner_is_null_on_a_tie(spark):
    df = edge_frame(spark, ("a", "x", 9, 3), ("a", "y", 9, 3), ("b", "x", 9, 3), ("b", "y", 9, 2))
    found = {r.src_id: r.winner for r in G.unique_winner(df).collect()}
    assert found == {"a": None, "b": "x"}


def test_sole_server_needs_the_same_period_and_one_child(spark):
    df = spans(
        spark,
        span("t", "one", "", "web", CLIENT, 10), span("t", "s1", "one", "api", SERVER, 11),
        span("t", "two", "", "web", CLIENT, 20), span("t", "s2", "two", "api", SERVER, 21),
        span("t", "s3", "two", "api", SERVER, 22),
        span("t", "late", "", "web", CLIENT, 99), span("t", "s4", "late", "api", SERVER, 101),
    )
    period = W.period_of("ts_ns", 0, 100 * S, 200 * S)
    rows = G.sole_server_gaps(df, period).collect()
    assert [(r.span_id, r.period, r.gap_ns) for r in rows] == [("one", "normal", S)]


def test_two_hops(spark):
    df = spark.createDataFrame(
        [("a", "b", 5), ("b", "c", 5), ("b", "d", 5), ("a", "c", 5), ("c", "d", 500)],
        "src_id string, dst_id string, observed_at long")
    assert {r.dst_id for r in G.two_hop_from(df, (0, 10), "a").collect()} == {"c", "d"}
    paths = {r.src_id: (r.middles, r.paths) for r in G.two_hop_paths(df, (0, 10)).collect()}
    assert paths == {"a": (1, 2)}


def test_logs_follow_their_span_not_their_trace(spark):
    df = spans(spark, *[span("t", f"s{i}", "", "web", SERVER, i) for i in range(50)])
    logs = spark.createDataFrame([("t", f"s{i % 3}", i) for i in range(60)],
                                 "trace_id string, span_id string, n int")
    assert G.correlate_logs(logs, df).count() == 60


def test_topology_status(spark):
    derived = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "src_id string, dst_id string")
    known = spark.createDataFrame([("a", "b"), ("x", "y")], "src_id string, dst_id string")
    found = {(r.src_id, r.dst_id): r.status for r in G.compare_topology(derived, known).collect()}
    assert found == {("a", "b"): "found", ("a", "c"): "extra", ("x", "y"): "missing"}
