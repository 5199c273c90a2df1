"""Descriptive tables over evaluated runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.statistics import null_strict_sum, only_value
from faultline.operators.evaluate import GRAPH_TOOL, SQL_TOOL
from faultline.operators.pairing import arm_pairs, case_effects, described, pair_deltas

# Points per matched dimension and the dimension they belong to.
RUBRIC = {
    "causal_scope_match": (10, "location"),
    "causal_locus_match": (30, "location"),
    "fault_category_match": (10, "root_cause"),
    "mechanism_code_match": (30, "root_cause"),
    "has_valid_citation": (5, "evidence"),
}
MAXIMUM = sum(points for points, _ in RUBRIC.values())
ALPHA = 0.05


def rejection_counts(citations: DataFrame, claim: str = "fault_mechanism") -> DataFrame:
    """F65. Every distinct code of a citation once, by treatment and whether it made the claim."""
    claims = F.coalesce(F.array_contains("claim_types", claim), F.lit(False))
    codes = citations.select(
        "treatment",
        claims.alias("claiming"),
        F.explode(F.array_distinct(F.concat("baseline_codes", "anomaly_codes"))).alias("code"),
    )
    return codes.groupBy("treatment", "code").agg(
        F.count_if("claiming").alias("claiming"),
        F.count_if(~F.col("claiming")).alias("not_claiming"),
    )


def grouped_effects(effects: DataFrame, keys: list[str], value: str = "case_median") -> DataFrame:
    """F66. Median and direction counts of case effects per group and metric."""
    return described(effects, [*keys, "metric"], value)


def group_currency(effects: DataFrame, keys: list[str]) -> DataFrame:
    """F66. The currency of a group if it has one."""
    named = effects.where(F.col("currency").isNotNull())
    return named.groupBy(*keys).agg(only_value("currency").alias("currency"))


def resource_effects(
    runs: DataFrame, metrics: list[str], baseline: str, treatment: str
) -> DataFrame:
    """F67. Case medians of resource deltas over eligible pairs, long format."""
    keys = ["model", "case_id", "repetition"]
    pairs = arm_pairs(runs, keys, "treatment", baseline, treatment, [*metrics, "eligible"])
    deltas = pair_deltas(pairs, keys, metrics, "eligible", baseline, treatment)
    return case_effects(deltas, ["model", "case_id"], metrics).where(F.col("metric").isin(*metrics))


def actual_costs(runs: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """F67. Spend per model, case and arm; null unless every repetition has a priced run."""
    repetitions = runs.groupBy("model", "case_id").agg(
        F.count_distinct("repetition").alias("repetitions")
    )
    spent = runs.where(F.col("treatment").isin(*arms)).groupBy("model", "case_id", "treatment").agg(
        F.count("cost").alias("priced"), F.sum("cost").alias("cost")
    )
    joined = spent.join(repetitions, ["model", "case_id"])
    return joined.select(
        "model", "case_id", "treatment",
        F.when(F.col("priced") == F.col("repetitions"), F.col("cost")).alias("actual_cost"),
    )


def model_costs(costs: DataFrame) -> DataFrame:
    """F67. Spend per model and arm, null as soon as a case has none."""
    return costs.groupBy("model", "treatment").agg(
        null_strict_sum("actual_cost").alias("actual_cost")
    )


def case_outcomes(effects: DataFrame, metrics: list[str]) -> DataFrame:
    """F68. Per case: models measured, and models with less of each metric."""
    parts = []
    for metric in metrics:
        here = F.when(F.col("metric") == metric, F.col("case_median"))
        parts += [
            F.count(here).alias(f"measured_{metric}"),
            F.count_if(here < 0).alias(f"fewer_{metric}"),
        ]
    return effects.groupBy("case_id").agg(*parts)


def correct_by(runs: DataFrame, group: str) -> DataFrame:
    """F69. Runs and correct diagnoses by case attribute, treatment and model, with totals.

    Runs fold to the finest cells first; the totals over models are a grouping set
    over the folded cells.
    """
    cells = runs.groupBy(group, "treatment", "model").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("diagnosis_correct").alias("correct")
    )
    per_model = cells.select(group, "treatment", "model", "runs", "correct")
    totals = cells.groupBy(group, "treatment").agg(
        F.sum("runs").alias("runs"), F.sum("correct").alias("correct")
    )
    return per_model.unionByName(totals.withColumn("model", F.lit("all")))


def join_kinds(tables: Column) -> Column:
    """F70. Signal kinds among the base tables of a statement."""
    return F.array_distinct(
        F.transform(
            tables,
            lambda t: F.when(F.lower(t) == "logs", "log")
            .when(F.lower(t) == "traces", "trace")
            .otherwise("metric"),
        )
    )


def tool_use(calls: DataFrame) -> DataFrame:
    """F70. Calls, successes, joins and cross-signal joins per treatment.

    Calls fold to one row per run first, so counting runs needs no distinct sets.
    """
    done = ~F.coalesce("failed", F.lit(False))
    joins = (
        done & (F.col("tool_name") == SQL_TOOL) & F.col("sql_text").rlike(r"(?i)\bJOIN\b")
    )
    crossed = joins & (F.size(join_kinds(F.col("base_tables"))) > 1)
    evaluated = (
        done
        & (F.col("tool_name") == "query_metrics")
        & F.col("operation").isin("query", "query_range")
    )
    graph = done & (F.col("tool_name") == GRAPH_TOOL)

    def times(flag: Column) -> Column:
        return F.count_if(F.coalesce(flag, F.lit(False)))

    per_run = calls.groupBy("treatment", "run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        times(done).alias("successes"),
        times(joins).alias("joins"),
        times(crossed).alias("crossed"),
        times(evaluated).alias("evaluated"),
        times(graph).alias("graph"),
    )
    return per_run.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("calls").alias("tool_calls"),
        F.sum("successes").alias("successful_calls"),
        F.sum("joins").alias("join_calls"),
        F.count_if(F.col("joins") > 0).alias("runs_with_join"),
        F.sum("crossed").alias("cross_signal_calls"),
        F.count_if(F.col("crossed") > 0).alias("runs_with_cross_signal"),
        F.count_if(F.col("evaluated") > 0).alias("runs_with_metric_evaluation"),
        F.sum("graph").alias("graph_calls"),
        F.count_if(F.col("graph") > 0).alias("runs_with_graph_call"),
    )


def tool_call_counts(calls: DataFrame) -> DataFrame:
    """F70. Calls and successes per treatment and tool."""
    return calls.groupBy("treatment", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.coalesce("failed", F.lit(False))).alias("successes"),
    )


def citation_submission(runs: DataFrame) -> DataFrame:
    """F71. Runs without any citation per model, and the correct diagnoses among them."""
    empty = F.coalesce("cited_evidence_count", F.lit(0)) == 0
    return runs.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(empty).alias("runs_without_citation"),
        F.count_if(empty & F.col("diagnosis_correct")).alias("correct_lost"),
    )


def capability_scores(runs: DataFrame, keys: list[str]) -> DataFrame:
    """F72. Rubric points per group; failed runs stay in the denominator.

    The proof of evidence is reported beside the score as covered, failed or not estimable.
    """
    hit = {
        name: (
            F.coalesce("valid_evidence_count", F.lit(0)) > 0
            if name == "has_valid_citation"
            else F.coalesce(name, F.lit(False))
        )
        for name in RUBRIC
    }
    counted = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(flag).alias(f"hits_{name}") for name, flag in hit.items()],
        F.count_if("required_evidence_covered").alias("covered"),
        F.count_if(~F.col("required_evidence_covered")).alias("failed"),
        F.count_if(F.col("required_evidence_covered").isNull()).alias("not_estimable"),
    )

    def points(dimension: str | None) -> Column:
        value = F.lit(0)
        for name, (worth, belongs) in RUBRIC.items():
            if dimension in (None, belongs):
                value = value + F.col(f"hits_{name}") * worth
        return value

    total = points(None)
    return counted.select(
        *keys,
        "runs",
        total.alias("points"),
        F.round(total / F.col("runs"), 2).alias("score"),
        F.round(F.lit(100) * total / (F.col("runs") * MAXIMUM), 2).alias("normalized_score"),
        *[
            F.round(points(d) / F.col("runs"), 2).alias(f"average_{d}")
            for d in ("location", "root_cause", "evidence")
        ],
        "covered", "failed", "not_estimable",
    )


def family_tally(endpoints: DataFrame, family: str) -> DataFrame:
    """F73. Endpoints per family: confirmed ones and the side most cases favour."""
    confirmed = F.coalesce(F.col("holm_adjusted_p") < ALPHA, F.lit(False))
    lead = F.signum(F.col("positive_cases") - F.col("negative_cases"))
    tally = endpoints.groupBy(family).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(lead < 0).alias("favouring_treatment"),
        F.count_if(lead > 0).alias("favouring_baseline"),
        F.count_if(lead == 0).alias("no_direction"),
    )
    return tally.withColumn(
        "status",
        F.when(F.col("confirmed") == F.col("total"), "supported")
        .when(F.col("confirmed") > 0, "partially_supported")
        .otherwise("not_supported"),
    )


def arm_ratios(rows: DataFrame, key: str, arm: str, value: str, better: str) -> DataFrame:
    """F74. Every arm against the best one. Null is missing, zero is measured; a zero
    reference gives no ratio. The first arm by name among equals is the best."""
    higher = F.col(better) == "higher"
    # Smallest signed value first, then the first name: both from one struct.
    signed = F.when(higher, -F.col(value)).otherwise(F.col(value))
    stats = rows.groupBy(key).agg(
        F.max(value).alias("_widest"),
        F.min(F.when(F.col(value).isNotNull(), F.struct(signed.alias("v"), F.col(arm).alias("arm")))).alias("_best"),
    )
    reference = F.when(higher, -F.col("_best.v")).otherwise(F.col("_best.v"))
    flagged = rows.join(stats, key).withColumn("reference", reference).withColumn("best", F.col("_best.arm"))
    return flagged.select(
        key, arm, value, "reference", "best",
        F.when(F.col("reference") != 0, F.col(value) / F.col("reference")).alias("ratio"),
        F.when(F.col("_widest") != 0, F.coalesce(value, F.lit(0)) / F.col("_widest"))
        .otherwise(F.lit(0.0))
        .alias("fraction"),
    )


def interval_ratios(rows: DataFrame, key: str, arm: str) -> DataFrame:
    """F74. Ratios of cost intervals: exactly one for an arm that is surely cheapest,
    otherwise an interval against the cheapest bounds; none for a zero reference."""
    best = rows.groupBy(key).agg(
        F.min("low").alias("_low"), F.min("high").alias("_high"),
        F.min(F.struct("low", arm)).alias("_first"),
    )
    joined = rows.join(best, key)
    # The lowest lower bound among the other arms.
    second = (
        joined.where(F.col(arm) != F.col(f"_first.{arm}"))
        .groupBy(key)
        .agg(F.min("low").alias("_second"))
    )
    both = joined.join(second, key, "left")
    others = F.when(F.col(arm) == F.col(f"_first.{arm}"), F.col("_second")).otherwise(
        F.col("_low")
    )
    cheapest = F.coalesce(F.col("high") <= others, F.lit(True))
    low = F.greatest(F.lit(1.0), F.col("low") / F.col("_high"))
    return both.select(
        key, arm, "low", "high",
        F.when(cheapest, 1.0).when(F.col("_low") > 0, low).alias("ratio_low"),
        F.when(cheapest, 1.0)
        .when(F.col("_low") > 0, F.col("high") / F.col("_low"))
        .alias("ratio_high"),
    )


def accuracy_rates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """F75. Correct rate per level and arm; zero runs give a rate of zero."""
    return cells.groupBy(*keys).agg(
        F.sum("correct").alias("correct"), F.sum("runs").alias("runs")
    ).withColumn(
        "rate",
        F.when(F.col("runs") > 0, F.col("correct") / F.col("runs")).otherwise(F.lit(0.0)),
    )


def headline_reductions(runs: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """F75. Reduction of wrong diagnoses and of input tokens, as shares of the baseline."""

    def at(arm: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("treatment") == arm, value)), F.lit(0))

    wrong = F.when(F.coalesce("diagnosis_correct", F.lit(False)), 0).otherwise(1)
    tokens = F.coalesce("input_tokens", F.lit(0))
    totals = runs.agg(
        at(baseline, wrong).alias("wb"), at(treatment, wrong).alias("wt"),
        at(baseline, tokens).alias("tb"), at(treatment, tokens).alias("tt"),
    )
    return totals.select(
        F.col("wb").alias("baseline_wrong"),
        F.col("wt").alias("treatment_wrong"),
        F.when(F.col("wb") > 0, (F.col("wb") - F.col("wt")) / F.col("wb")).alias("wrong_reduction"),
        F.when(F.col("tb") > 0, (F.col("tb") - F.col("tt")) / F.col("tb")).alias("token_reduction"),
    )


def reliability(runs: DataFrame, keys: list[str]) -> DataFrame:
    """F76."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("runner_error").alias("runner_errors"),
        F.count_if("tool_budget_exhausted").alias("budget_exhaustions"),
        F.coalesce(F.sum("failed_queries"), F.lit(0)).alias("failed_queries"),
        F.coalesce(F.sum("rejected_calls"), F.lit(0)).alias("rejected_calls"),
    )


def sample_range(endpoints: DataFrame) -> DataFrame:
    """F77. Smallest and largest eligible sample over all endpoints."""
    return endpoints.agg(
        F.min("eligible_cases").alias("smallest_sample"),
        F.max("eligible_cases").alias("largest_sample"),
    )


def position_balance(runs: DataFrame, case: str, arm: str, position: str) -> DataFrame:
    """F78. Whether every treatment of a case was run equally often in each position.

    Positions are 0..number of treatments - 1; a missing cell counts zero, and a
    case with one treatment is balanced.
    """
    cells = runs.groupBy(case, arm, position).agg(F.count(F.lit(1)).alias("n"))
    arms = cells.groupBy(case).agg(F.count_distinct(arm).alias("arms"))
    per_arm = (
        cells.join(arms, case)
        .where(F.col(position).between(0, F.col("arms") - 1))
        .groupBy(case, arm, "arms")
        .agg(
            F.count(F.lit(1)).alias("positions"), F.min("n").alias("low"), F.max("n").alias("high")
        )
    )
    even = (F.col("positions") == F.col("arms")) & (F.col("low") == F.col("high"))
    # An arm that was never in a valid position has only zero cells, which is even.
    judged = per_arm.groupBy(case).agg(F.bool_and(even).alias("even"))
    return arms.join(judged, case, "left").select(
        case, ((F.col("arms") <= 1) | F.coalesce("even", F.lit(True))).alias("balanced")
    )


def merge_cohorts(first: DataFrame, second: DataFrame, contract: list[str]) -> DataFrame:
    """F80. Runs of two cohorts with disjoint models and equal contracts, for recomputation.

    The result carries a violation flag per model instead of failing half-way.
    """
    union = first.withColumn("_cohort", F.lit(1)).unionByName(
        second.withColumn("_cohort", F.lit(2))
    )
    shared = union.groupBy("model").agg(
        (F.min("_cohort") < F.max("_cohort")).alias("shared_model")
    )
    terms = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in contract]), 256)
    contracts = union.groupBy("model").agg(
        (F.min(terms) < F.max(terms)).alias("mixed_contract")
    )
    return union.drop("_cohort").join(shared, "model").join(contracts, "model")


def direction_by_model(effects: DataFrame, keys: list[str], value: str) -> DataFrame:
    """F81. Models that improved, tied or regressed per group."""
    v = F.col(value)
    return effects.groupBy(*keys).agg(
        F.count_if(v < 0).alias("improved_models"),
        F.count_if(v == 0).alias("tied_models"),
        F.count_if(v > 0).alias("regressed_models"),
    )


def completeness(schedule: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """F88. Scheduled against completed cells, with errors and exhausted budgets."""
    done = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.bool_or("runner_error").alias("error"),
        F.bool_or("tool_budget_exhausted").alias("exhausted"),
    )
    joined = schedule.select(*keys).distinct().join(done, keys, "left")
    counted = joined.agg(
        F.count(F.lit(1)).alias("expected_cells"),
        F.count("runs").alias("completed_cells"),
        F.count_if("error").alias("runner_errors"),
        F.count_if("exhausted").alias("budget_exhaustions"),
    )
    return counted.withColumn("complete", F.col("expected_cells") == F.col("completed_cells"))


def concurrency_deviations(runs: DataFrame, limit: int) -> DataFrame:
    """F89. Runs above the frozen concurrency limit; a missing value is the limit."""
    actual = F.coalesce("concurrency_limit", F.lit(limit))
    return runs.where(actual > limit).withColumn("frozen_limit", F.lit(limit))


def cohort_sizes(cases: DataFrame, code: str) -> DataFrame:
    """F90. Cases per mechanism, largest first."""
    return (
        cases.groupBy(code)
        .agg(F.count(F.lit(1)).alias("cases"))
        .orderBy(F.col("cases").desc(), code)
    )


def retry_ledger(attempts: DataFrame, ceiling: int = 3) -> DataFrame:
    """F92. Per cell: attempts are 1..n within the ceiling and no record is used twice."""
    reused = (
        attempts.groupBy("record").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    )
    flagged = attempts.join(reused, "record", "left")
    return flagged.groupBy("cell").agg(
        F.count(F.lit(1)).alias("attempts"),
        (
            (F.count(F.lit(1)) == F.max("attempt"))
            & (F.count_distinct("attempt") == F.max("attempt"))
            & (F.min("attempt") == 1)
            & (F.max("attempt") <= ceiling)
        ).alias("sequence_valid"),
        F.coalesce(F.bool_or(F.col("uses") > 1), F.lit(False)).alias("record_reused"),
    )


def retained_failures(failed_cells: DataFrame, retained: DataFrame) -> DataFrame:
    """F92. Failed cells and retained records that do not match one to one."""
    kept = retained.groupBy("cell").agg(F.count(F.lit(1)).alias("records"))
    cells = failed_cells.select("cell").distinct().withColumn("failed", F.lit(True))
    return (
        cells.join(kept, "cell", "full_outer")
        .where(
            F.col("failed").isNull() | F.col("records").isNull() | (F.col("records") > 1)
        )
        .select("cell", F.coalesce("records", F.lit(0)).alias("records"),
                F.coalesce("failed", F.lit(False)).alias("failed"))
    )


def _count_of(text: Column, kind: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]", ""))


def _json_text_bytes(text: Column) -> Column:
    """Bytes of a text as an ASCII JSON string: two for short escapes, six for a \\u escape, and
    two of these beyond the basic plane."""
    short = _count_of(text, r'"\\\n\r\t\x08\x0c')
    long = _count_of(text, r"\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}")
    pairs = _count_of(text, r"\x{10000}-\x{10ffff}")
    return 2 + F.length(text) + short + 5 * long + 11 * pairs


def _json_double_bytes(value: Column) -> Column:
    """Bytes of a double in shortest form: positional from 1e-4 to below 1e16, else with exponent."""
    text = F.abs(value).cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.0$|\.", "")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    n = F.length(digits)
    positional = (
        F.when(exponent < 0, 1 - exponent + n)
        .when(n <= exponent + 1, exponent + 3)
        .otherwise(n + 1)
    )
    scientific = (
        F.when(n > 1, n + 1).otherwise(n) + 2 + F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2))
    )
    size = (
        F.when(exponent.isNull(), F.length(text))
        .when(exponent.between(-4, 15), positional)
        .otherwise(scientific)
    )
    return size + F.when(value.cast("string").startswith("-"), 1).otherwise(0)


def _json_bytes(field, column: Column) -> Column:
    kind = field.dataType.typeName()
    if kind in ("double", "float"):
        size = _json_double_bytes(column.cast("double"))
    elif kind in ("byte", "short", "integer", "long", "boolean"):
        size = F.length(column.cast("string"))
    else:
        size = _json_text_bytes(column.cast("string"))
    return F.coalesce(size, F.lit(len("null")))


def result_sizes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """F93. Items and bytes of the canonical JSON per query result.

    The document is {"columns":[...],"rows":[[...],...]} without blanks and in ASCII: the envelope,
    one sum of row sizes that combines map-side, and a comma between rows.
    """
    fields = {f.name: f for f in rows.schema.fields}
    row = sum((_json_bytes(fields[c], F.col(c)) for c in columns), F.lit(2 + len(columns) - 1))
    names = json.dumps(columns, separators=(",", ":"))
    envelope = len('{"columns":,"rows":[]}') + len(names)
    count = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        count.alias("returned_items"),
        (F.sum(row.cast("bigint")) + count - 1 + envelope).alias("result_bytes"),
    )


def scope_contrast(cells: DataFrame, treatment: str, baseline: str) -> DataFrame:
    """F94. Models with more and with fewer correct diagnoses under the treatment."""
    per_model = cells.groupBy("model").agg(
        F.sum(F.when(F.col("treatment") == treatment, F.col("correct"))).alias("t"),
        F.sum(F.when(F.col("treatment") == baseline, F.col("correct"))).alias("b"),
    )
    return per_model.agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if(F.col("t") > F.col("b")).alias("better"),
        F.count_if(F.col("t") < F.col("b")).alias("worse"),
    )


def with_context(runs: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """E11. Runs with the attributes of their case; a run of an unknown case ends the job."""
    found = runs.join(cases.withColumn("_known", F.lit(True)), key, "left")
    lost = F.raise_error(F.concat(F.lit("no context for case "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_known"), F.lit(True)).otherwise(lost.cast("boolean"))).drop("_known")
