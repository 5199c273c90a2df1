"""From recorded runs to evaluated runs: citations, flags, eligibility and resources.

The result is what `faultline.jobs.report` and the pairing operators start from. Every per-run fact
is an aggregate by run, so the facts meet in joins on the run id and a long run combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.statistics import null_strict_sum
from faultline.operators import evaluate as V
from faultline.operators import reporting as R
from faultline.operators import usage as U
from faultline.session import configure, cut_lineage
from faultline.sources import case_files, sinks


def submitted(records: DataFrame) -> DataFrame:
    """What each run submitted and how it ended."""
    return records.select(
        "run_id", "model", "case_id", "repetition", F.col("visibility").alias("treatment"),
        F.col("run.diagnosis.causal_scope").alias("scope"),
        F.col("run.diagnosis.causal_component").alias("component"),
        F.col("run.diagnosis.edge_source").alias("edge_source"),
        F.col("run.diagnosis.edge_destination").alias("edge_destination"),
        F.col("run.diagnosis.fault_category").alias("fault_category"),
        F.col("run.diagnosis.mechanism_code").alias("mechanism"),
        F.col("run.diagnosis.causal_operation").alias("operation"),
        F.col("run.error").isNotNull().alias("runner_error"),
        F.coalesce("run.tool_budget_exhausted", F.lit(False)).alias("tool_budget_exhausted"),
        F.lit(True).alias("runner_contract_match"),
        F.col("run.usage.input_tokens").alias("input_tokens"),
        F.col("run.usage.output_tokens").alias("output_tokens"),
    )


def evaluated_runs(records: DataFrame, cases: DataFrame, max_calls: int) -> DataFrame:
    """One row per recorded run with its match flags, citation facts, eligibility and resources.

    `records` is `read_runs`; `cases` has case_id and the `true_` columns of `scoped_matches`. A
    run of an unknown case ends the job. The records are parsed once. What a run has
    besides its calls is dealt by run id once; of its calls, counts alone are. Planned with
    `session.DEALT_ONCE`, citations meet the calls they name without being dealt again.
    """
    configure(records.sparkSession)
    parts = cut_lineage(case_files.parted_runs(records), "calls")
    records = sinks.write_runs(parts.drop("calls"))
    calls, named = case_files.counted_calls(parts), case_files.named_calls(records)
    citations = case_files.run_citations(records)
    rejections = case_files.run_rejections(records)
    integrity = V.citation_integrity(V.resolve_citations(citations, named))
    counts = V.call_counts(
        calls, citations, rejections, named, {"rows_returned": null_strict_sum("rows_returned")})
    invalid = rejections.where(F.col("reason_code") == "invalid").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("invalid_calls"))
    runs = submitted(records)
    for facts in (integrity, counts, invalid):
        runs = runs.join(facts, "run_id", "left")
    runs = V.scoped_matches(R.with_context(runs, cases))
    runs = runs.withColumn("tool_calls_executed", F.coalesce("tool_calls_executed", F.lit(0)))
    runs = runs.withColumn("execution_reliability", V.execution_reliability(max_calls))
    flags = V.eligibility()
    return runs.withColumns(flags).withColumns({
        "eligible": F.coalesce(F.col("efficiency_eligible"), F.lit(False)),
        "tool_calls": F.col("tool_calls_executed"),
    })


def priced_runs(runs: DataFrame, responses: DataFrame, rates: DataFrame) -> DataFrame:
    """F53/F54. Runs with their input breakdown, cost and currency.

    `responses`: run_id, usage; `rates` per model: currency and the rates of `estimated_cost`. A run
    without responses, or of a model without rates, has no cost.
    """
    parts = U.input_breakdown(responses, ["run_id"])
    joined = runs.join(parts, "run_id", "left").join(rates, "model", "left").withColumns({
        c: F.coalesce(c, F.lit(False)) for c in ("cache_breakdown_complete", "cache_creation_known")})
    priced = joined.withColumn("cost", U.estimated_cost())
    return priced.select(*runs.columns, *[c for c in parts.columns if c != "run_id"], "currency", "cost")


def adjudicated_runs(
    runs: DataFrame, decisions: DataFrame, humans: DataFrame, judges: tuple[str, ...],
    packet: list[str], binding: list[str],
) -> DataFrame:
    """F49-F51. Evaluated runs after the judges' decisions on those whose evidence was in doubt.

    `packet` is what judges see, `binding` what ties a candidate to its run; together they tell runs
    apart. A missing, doubled or misplaced decision ends the job with the candidate's name.
    """
    queued = cut_lineage(
        runs.where(V.needs_adjudication()).select("run_id", V.candidate_id(packet, binding).alias("candidate")), "queue"
    )
    resolved = V.resolve_adjudication(queued, decisions, humans, judges)
    message = F.raise_error(F.concat_ws(": ", "problem", "candidate")).cast("boolean")
    sound = resolved.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(message))
    accepted = queued.join(sound, "candidate").select("run_id", "sufficient")
    return V.apply_adjudication(runs.withColumn("semantic_adjudication_required", V.needs_adjudication()), accepted)
