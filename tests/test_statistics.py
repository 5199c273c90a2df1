"""Published results of the paired statistics, and the report rules around them."""

import math

import pytest
from pyspark.sql import functions as F

from faultline.functions.statistics import sign_test
from faultline.operators import pairing as P
from faultline.operators import reporting as R
from faultline.operators import usage as U

# Fewer, tied and more cases of both endpoints with their exact and Holm-adjusted p.
FIRST_FAMILY = [
    ("a", 7, 1, 0.0703125, 0.421875), ("a", 8, 0, 0.0078125, 0.0546875),
    ("b", 4, 0, 0.125, 0.625), ("b", 3, 3, 1.0, 1.0),
    ("c", 7, 5, 0.7744140625, 1.0), ("c", 13, 0, 0.000244140625, 0.001953125),
    ("d", 2, 0, 0.5, 1.0), ("d", 2, 0, 0.5, 1.0),
]
SECOND_FAMILY = [
    ("e", 2, 7, 0.1796875, 0.1796875), ("e", 10, 1, 0.01171875, 0.03515625),
    ("f", 11, 3, 0.057373046875, 0.11474609375), ("f", 13, 1, 0.0018310546875, 0.00732421875),
]


@pytest.mark.parametrize("family", [FIRST_FAMILY, SECOND_FAMILY])
def test_published_p_values(spark, family):
    df = spark.createDataFrame(
        [(i, "goal", f, m, p, h) for i, (_, f, m, p, h) in enumerate(family)],
        "i int, family string, fewer long, more long, p double, holm double",
    ).withColumn("got_p", sign_test("fewer", "more"))
    rows = P.holm(df, ["family"], "got_p", len(family)).collect()
    assert len(rows) == len(family)
    for r in rows:
        assert math.isclose(r.got_p, r.p, rel_tol=1e-12)
        assert math.isclose(r.holm_adjusted_p, r.holm, rel_tol=1e-12)


def run(case, repetition, arm, rows, calls, eligible=True):
    return ("m", case, repetition, arm, rows, calls, eligible)


SCHEMA = (
    "model string, case_id string, repetition int, treatment string, rows_returned long, "
    "tool_calls long, eligible boolean"
)
KEYS = ["model", "case_id", "repetition"]
METRICS = ["rows_returned", "tool_calls"]


def deltas(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = P.arm_pairs(df, KEYS, "treatment", "raw", "graph", [*METRICS, "eligible"])
    return P.pair_deltas(pairs, KEYS, METRICS, "eligible", "raw", "graph")


def test_inference_is_over_case_medians(spark):
    found = deltas(spark, [
        run("c1", 0, "raw", 100, 12), run("c1", 0, "graph", 40, 8),
        run("c1", 1, "raw", 100, 12), run("c1", 1, "graph", 60, 8),
        run("c2", 0, "raw", 100, 12), run("c2", 0, "graph", 100, 12),
    ])
    effects = P.case_effects(found, ["model", "case_id"], METRICS)
    summary = {r.metric: r for r in P.effect_summary(effects, ["model"]).collect()}
    rows = summary["rows_returned"]
    assert (rows.eligible_cases, rows.negative_cases, rows.tied_cases, rows.positive_cases) == (
        2, 1, 1, 0)
    assert rows.case_median_delta == -25.0
    assert rows.sign_test_p == 1.0
    assert summary["rows_returned_relative"].case_median_delta == -0.25


def test_null_rows_stay_null_and_ineligible_pairs_have_no_delta(spark):
    found = {
        r.case_id: r
        for r in deltas(spark, [
            run("null", 0, "raw", None, 5), run("null", 0, "graph", 3, 4),
            run("zero", 0, "raw", 0, 5), run("zero", 0, "graph", 3, 4),
            run("lost", 0, "raw", 9, 5), run("lost", 0, "graph", 3, 4, False),
        ]).collect()
    }
    assert found["null"].rows_returned is None and found["null"].tool_calls == -1
    assert found["zero"].rows_returned == 3 and found["zero"].rows_returned_relative is None
    assert found["lost"].status == "raw_only" and found["lost"].tool_calls is None


def test_a_missing_arm_is_named(spark):
    df = spark.createDataFrame([run("c", 0, "raw", 1, 1)], SCHEMA)
    pairs = P.arm_pairs(df, KEYS, "treatment", "raw", "graph", ["eligible"])
    assert [r.case_id for r in P.incomplete_pairs(pairs, KEYS).collect()] == ["c"]


def test_overlay_rejects_a_changed_schedule(spark):
    base = spark.createDataFrame([(1, "m", 5), (2, "m", 6)], "cell int, model string, v int")
    good = spark.createDataFrame([(2, "m", 60)], "cell int, model string, v int")
    merged = P.overlay(base, good, "cell", ["model"]).orderBy("cell").collect()
    assert [(r.v, r.replaced) for r in merged] == [(5, False), (60, True)]
    bad = good.withColumn("model", F.lit("other"))
    with pytest.raises(Exception, match="schedule differs"):
        P.overlay(base, bad, "cell", ["model"]).collect()
    with pytest.raises(Exception, match="unknown cell"):
        P.overlay(base, good.withColumn("cell", F.lit(7)), "cell", ["model"]).collect()
    with pytest.raises(Exception, match="several replacements"):
        P.overlay(base, good.union(good), "cell", ["model"]).collect()


def test_a_run_without_case_ends_the_job(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run int, case_id string")
    cases = spark.createDataFrame([("a", "x")], "case_id string, scope string")
    assert R.with_context(runs.where("run = 1"), cases).first().scope == "x"
    with pytest.raises(Exception, match="no context for case b"):
        R.with_context(runs, cases).select("run").collect()


USAGES = [
    # usage object, uncached, read, write, split
    ('{"input_tokens":120,"cache_creation_input_tokens":40,"cache_read_input_tokens":2176}',
     120, 2176, 40, True),
    ('{"input_tokens":2296,"prompt_cache_hit_tokens":2176,"prompt_cache_miss_tokens":120}',
     120, 2176, 0, True),
    ('{"input_tokens":120,"input_tokens_details":{"cached_tokens":80,"cache_write_tokens":10}}',
     30, 80, 10, True),
    ('{"input_tokens":120,"output_tokens":20}', 0, 0, 0, False),
    ('{"prompt_tokens":10,"prompt_tokens_details":{"cached_tokens":50}}', 0, 0, 0, False),
    ('{"prompt_tokens":100,"prompt_tokens_details":{"cached_tokens":0},"x_details":'
     '[{"prompt_tokens_details":{"cached_tokens":30,"cache_creation_input_tokens":5}},'
     '{"prompt_tokens_details":{"cached_tokens":10,"cache_creation_input_tokens":1}}]}',
     54, 40, 6, True),
]


def test_provider_usage_shapes(spark):
    df = spark.createDataFrame(
        [(i, u[0]) for i, u in enumerate(USAGES)], "run int, usage string"
    )
    for r in U.input_breakdown(df, ["run"]).collect():
        _, uncached, read, write, split = USAGES[r.run]
        assert (r.uncached_input_tokens, r.cache_read_input_tokens, r.cache_write_input_tokens,
                r.cache_breakdown_complete) == (uncached, read, write, split), r.run


def test_one_response_without_split_makes_the_run_incomplete(spark):
    df = spark.createDataFrame([(1, USAGES[1][0]), (1, USAGES[3][0])], "run int, usage string")
    row = U.input_breakdown(df, ["run"]).first()
    assert not row.cache_breakdown_complete
    rated = U.input_breakdown(df, ["run"]).selectExpr(
        "*", "240L input_tokens", "20L output_tokens", "true cost_available",
        "false creation_required", "0.44D input_rate", "0.014D hit_rate",
        "cast(null as double) write_rate", "1.32D output_rate")
    assert rated.select(U.estimated_cost().alias("c")).first().c is None


def test_cost_from_cache_breakdown(spark):
    df = spark.createDataFrame([(1, USAGES[0][0])], "run int, usage string")
    rated = U.input_breakdown(df, ["run"]).selectExpr(
        "*", "2336L input_tokens", "150L output_tokens", "true cost_available",
        "false creation_required", "2D input_rate", "0.2D hit_rate", "2.5D write_rate",
        "10D output_rate")
    cost = rated.select(U.estimated_cost().alias("c")).first().c
    assert cost == pytest.approx((120 * 2 + 40 * 2.5 + 2176 * 0.2 + 150 * 10) / 1_000_000)


def test_bounds_reject_cached_tokens_above_the_prompt(spark):
    bad = '{"prompt_tokens":10,"total_tokens":12,"prompt_tokens_details":{"cached_tokens":11}}'
    df = spark.createDataFrame([(1, bad)], "run int, usage string")
    with pytest.raises(Exception, match="invalid response token counts"):
        U.cache_observation(df, ["run"]).collect()


def test_spend_counts_only_models_priced_in_one_currency(spark):
    runs = spark.createDataFrame([
        ("a", "raw", 10, 1, 2.0, "USD"), ("a", "graph", 20, 1, 3.0, "USD"),
        ("b", "raw", 10, 1, 9.0, "USD"), ("b", "graph", 20, 1, None, "USD"),
        ("c", "raw", 10, 1, 6.7179, "CNY"), ("c", "graph", None, 1, 6.7179, "CNY"),
    ], "model string, treatment string, input_tokens long, output_tokens long, cost double, "
       "currency string")
    rates = spark.createDataFrame([("USD", 1.0), ("CNY", 1 / 6.7179)],
                                  "currency string, per_unit_usd double")
    got = {r.treatment: r for r in U.usage_by_treatment(runs, rates).collect()}
    assert got["raw"].input_tokens == 30 and got["graph"].input_tokens == 40
    assert got["raw"].estimated_cost_usd == pytest.approx(3.0)
    assert got["graph"].estimated_cost_usd == pytest.approx(4.0)
    with pytest.raises(Exception, match="no frozen exchange rate"):
        U.usage_by_treatment(runs, rates.where("currency = 'USD'")).collect()
