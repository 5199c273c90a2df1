"""Report from evaluated runs: pairs to case effects to exact statistics.

The case effects and the endpoints are written once to the shared work folder,
because several tables start from them; all other steps stay lazy until their
table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import pairing as P
from faultline.operators import reporting as R
from faultline.operators import usage as U
from faultline.session import configure, cut_lineage
from faultline.sources.sinks import write_report

PAIR = ["model", "case_id", "repetition"]


Tables = dict[str, tuple[DataFrame, list[str]]]

USAGE_FIELDS = ["input_tokens", "output_tokens", "rows_returned"]


def usage_tables(runs: DataFrame, usd_rates: DataFrame) -> Tables:
    """Tokens, spend and cost status, each table with its order.

    `runs`: model, case_id, repetition, treatment, tokens, rows_returned, cost, currency and
    cache_breakdown_complete; `usd_rates`: currency, per_unit_usd. A run without a price has a null
    cost, and every sum over it is null; what is known stands beside it per currency.
    """
    parts = runs.groupBy("model", "treatment").agg(
        F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"),
        F.when(F.min("currency") == F.max("currency"), F.min("currency")).alias("currency"),
        F.bool_or(F.col("cost").isNotNull()).alias("cost_available"),
        F.coalesce(F.bool_and("cache_breakdown_complete"), F.lit(False)).alias("breakdown_complete"),
    ).withColumnRenamed("treatment", "cohort")
    report = cut_lineage(U.cost_report(parts), "costs")
    return {
        "usage": (U.usage_totals(runs, ["model", "treatment"], USAGE_FIELDS), ["model", "treatment"]),
        "usage_by_treatment": (U.usage_by_treatment(runs, usd_rates), ["treatment"]),
        "spend": (U.spend_by_currency(runs), ["treatment", "currency"]),
        "cost_status": (report, ["model"]),
        "cost_totals": (U.cost_totals(report), ["currency"]),
        "cost_in_usd": (U.cross_currency_total(report, usd_rates), ["usd_total"]),
    }


def measurement_report(
    runs: DataFrame,
    cases: DataFrame,
    baseline: str,
    treatment: str,
    metrics: list[str],
    family_size: int,
    path: str,
    zero_for_null: tuple[str, ...] = (),
    usd_rates: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Writes the report tables below `path` and returns them; with `usd_rates` also usage and cost.

    `runs`: model, case_id, repetition, treatment, eligible, diagnosis_correct, the match
    flags of the rubric and the metrics. Missing arms are reported, not skipped silently.
    """
    configure(runs.sparkSession)
    pairs = P.arm_pairs(runs, PAIR, "treatment", baseline, treatment, [*metrics, "eligible"])
    deltas = P.pair_deltas(pairs, PAIR, metrics, "eligible", baseline, treatment, zero_for_null)
    effects = cut_lineage(P.case_effects(deltas, ["model", "case_id"], metrics), "case-effects")
    tested = effects.where(effects.metric.isin(*metrics))
    endpoints = cut_lineage(P.effect_summary(tested, ["model"]), "endpoints")
    adjusted = P.holm(endpoints, ["metric"], "sign_test_p", family_size)
    named = R.with_context(effects, cases)
    tables = {
        "incomplete_pairs": (P.incomplete_pairs(pairs, PAIR), PAIR),
        "disposition": (P.disposition(deltas, ["model"]), ["model", "status"]),
        "endpoints": (adjusted, ["metric", "model"]),
        "families": (R.family_tally(adjusted, "metric"), ["metric"]),
        "mechanisms": (
            R.grouped_effects(named, ["model", "mechanism_code"]),
            ["model", "mechanism_code", "metric"],
        ),
        "cases": (R.case_outcomes(effects, metrics), ["case_id"]),
        "capability": (
            R.capability_scores(runs, ["model", "treatment"]), ["model", "treatment"]
        ),
        "correct_by_scope": (
            R.correct_by(R.with_context(runs, cases), "causal_scope"),
            ["causal_scope", "treatment", "model"],
        ),
    }
    if usd_rates is not None:
        tables |= usage_tables(runs, usd_rates)
    for name, (table, order) in tables.items():
        write_report(table, f"{path}/{name}", order)
    spark = runs.sparkSession
    return {
        name: spark.read.schema(table.schema).json(f"{path}/{name}/table")
        for name, (table, _) in tables.items()
    }
