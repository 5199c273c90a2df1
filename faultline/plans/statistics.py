"""Paired statistics, usage, cost and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.jobs.evaluation import evaluated_runs
from faultline.jobs.report import usage_tables
from faultline.operators import pairing as P
from faultline.operators import reporting as R
from faultline.operators import usage as U
from faultline.plans.registry import query
from faultline.session import DEALT_ONCE, SHUFFLES_GO, cut_lineage, settings, work_dir
from faultline.sources import case_files

KEYS = ["model", "case_id", "repetition"]
METRICS = ["rows_returned", "tool_calls", "input_tokens", "reported_tokens"]
TOKENS = ("input_tokens", "reported_tokens")

REPORTED = """rr AS (SELECT *, coalesce(input_tokens, 0) + output_tokens AS reported_tokens FROM runs)"""
PAIRS = f"""{REPORTED}, b AS (SELECT * FROM rr WHERE treatment = 'split'),
  t AS (SELECT * FROM rr WHERE treatment = 'raw'),
  pr AS (SELECT b.model, b.case_id, b.repetition, b.eligible AS be, t.eligible AS te,
    b.rows_returned AS br, t.rows_returned AS tr, b.tool_calls AS bc, t.tool_calls AS tc,
    coalesce(b.input_tokens, 0) AS bi, coalesce(t.input_tokens, 0) AS ti,
    b.reported_tokens AS bt, t.reported_tokens AS tt
    FROM b JOIN t ON b.model = t.model AND b.case_id = t.case_id AND b.repetition = t.repetition),
  de AS (SELECT model, case_id, repetition, be AND te AS eligible,
    CASE WHEN be AND te THEN 'both' WHEN be THEN 'split_only' WHEN te THEN 'raw_only' ELSE 'neither' END
      AS status,
    CASE WHEN be AND te THEN tr - br END AS rows_returned,
    CASE WHEN be AND te AND br <> 0 THEN (tr - br) / br::DOUBLE END AS rows_returned_relative,
    CASE WHEN be AND te THEN tc - bc END AS tool_calls,
    CASE WHEN be AND te AND bc <> 0 THEN (tc - bc) / bc::DOUBLE END AS tool_calls_relative,
    CASE WHEN be AND te THEN ti - bi END AS input_tokens,
    CASE WHEN be AND te AND bi <> 0 THEN (ti - bi) / bi::DOUBLE END AS input_tokens_relative,
    CASE WHEN be AND te THEN tt - bt END AS reported_tokens,
    CASE WHEN be AND te AND bt <> 0 THEN (tt - bt) / bt::DOUBLE END AS reported_tokens_relative
    FROM pr)"""
NAMES = [n for m in METRICS for n in (m, f"{m}_relative")]
LONG = " UNION ALL ".join(
    f"SELECT model, case_id, '{n}' AS metric, {n}::DOUBLE AS v FROM de WHERE eligible" for n in NAMES
)
EFFECTS = f"""lo AS ({LONG}), ce AS (SELECT model, case_id, metric, median(v) AS case_median FROM lo
  WHERE v IS NOT NULL GROUP BY model, case_id, metric)"""
TAIL = """CASE WHEN n > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i:
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END"""
SUMMARY = f"""su AS (SELECT *, negative_cases + positive_cases AS n, least(negative_cases, positive_cases) AS k
  FROM (SELECT model, metric, count(*) AS eligible_cases, median(case_median) AS case_median_delta,
    count(CASE WHEN case_median < 0 THEN 1 END) AS negative_cases,
    count(CASE WHEN case_median = 0 THEN 1 END) AS tied_cases,
    count(CASE WHEN case_median > 0 THEN 1 END) AS positive_cases FROM ce GROUP BY model, metric))"""


def reported(t):
    return t.runs.withColumn(
        "reported_tokens", F.coalesce("input_tokens", F.lit(0)) + F.col("output_tokens")
    )


def pairs(t, extra=()):
    return P.arm_pairs(
        reported(t), KEYS, "treatment", "split", "raw", [*METRICS, "eligible", *extra]
    )


def deltas(t):
    return P.pair_deltas(pairs(t), KEYS, METRICS, "eligible", "split", "raw", TOKENS)


def effects(t):
    return P.case_effects(deltas(t), ["model", "case_id"], METRICS)


def summary(t):
    return P.effect_summary(effects(t), ["model"])


@query(
    "e10_arm_pairs",
    "runs",
    f""", {PAIRS} SELECT model, case_id, repetition, br AS b_rows_returned, tr AS t_rows_returned,
          bc AS b_tool_calls, tc AS t_tool_calls FROM pr""",
)
def arm_pairs(t):
    rows = pairs(t).where((F.col("b_runs") == 1) & (F.col("t_runs") == 1))
    return rows.select(
        *KEYS, "b_rows_returned", "t_rows_returned", "b_tool_calls", "t_tool_calls"
    )


@query(
    "e10_incomplete_pairs",
    "runs",
    """SELECT model, case_id, repetition, count(CASE WHEN treatment = 'split' THEN 1 END) AS b_runs,
         count(CASE WHEN treatment = 'raw' THEN 1 END) AS t_runs FROM runs
       WHERE treatment IN ('split', 'raw') GROUP BY model, case_id, repetition HAVING count(*) <> 2""",
)
def incomplete(t):
    return P.incomplete_pairs(pairs(t), KEYS)


@query(
    "e11_runs_with_context",
    "runs case_table",
    """SELECT causal_scope, mechanism_code, treatment, count(*) AS runs FROM runs
       JOIN case_table USING (case_id) GROUP BY ALL""",
)
def context(t):
    return (
        R.with_context(t.runs, t.case_table)
        .groupBy("causal_scope", "mechanism_code", "treatment")
        .agg(F.count(F.lit(1)).alias("runs"))
    )


@query(
    "e12_rerun_overlay",
    "runs",
    """SELECT run_id, CASE WHEN treatment = 'split' THEN tool_calls + 100 ELSE tool_calls END AS tool_calls,
         CASE WHEN treatment = 'split' THEN false ELSE eligible END AS eligible,
         treatment = 'split' AS replaced FROM runs""",
)
def overlay(t):
    base = t.runs.select("run_id", *KEYS, "treatment", "tool_calls", "eligible")
    rerun = base.where(F.col("treatment") == "split").withColumns(
        {"tool_calls": F.col("tool_calls") + 100, "eligible": F.lit(False)}
    )
    merged = P.overlay(base, rerun, "run_id", [*KEYS, "treatment"])
    return merged.select("run_id", "tool_calls", "eligible", "replaced")


@query(
    "f59_pair_deltas",
    "runs",
    f""", {PAIRS} SELECT model, case_id, repetition, eligible, status, rows_returned, tool_calls,
          input_tokens, round(rows_returned_relative, 6) AS rows_returned_relative,
          round(input_tokens_relative, 6) AS input_tokens_relative FROM de""",
)
def pair_deltas(t):
    return deltas(t).select(
        *KEYS, "eligible", "status", "rows_returned", "tool_calls", "input_tokens",
        F.round("rows_returned_relative", 6).alias("rows_returned_relative"),
        F.round("input_tokens_relative", 6).alias("input_tokens_relative"),
    )


@query(
    "f60_case_medians",
    "runs",
    f""", {PAIRS}, {EFFECTS} SELECT model, case_id, metric, round(case_median, 6) AS case_median FROM ce""",
)
def case_medians(t):
    return effects(t).withColumn("case_median", F.round("case_median", 6))


@query(
    "f60_effect_medians",
    "runs",
    f""", {PAIRS}, {EFFECTS} SELECT model, metric, round(median(case_median), 6) AS case_median_delta
          FROM ce GROUP BY model, metric""",
)
def effect_medians(t):
    return summary(t).select(
        "model", "metric", F.round("case_median_delta", 6).alias("case_median_delta")
    )


@query(
    "f61_directions",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {SUMMARY}
        SELECT model, metric, eligible_cases, negative_cases, tied_cases, positive_cases FROM su""",
)
def directions(t):
    return effects(t).groupBy("model", "metric").agg(
        *[c.alias(n) for n, c in P.directions("case_median").items()]
    )


@query(
    "f62_sign_test",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {SUMMARY} SELECT model, metric, round({TAIL}, 9) AS sign_test_p FROM su""",
)
def sign_test(t):
    return summary(t).select("model", "metric", F.round("sign_test_p", 9).alias("sign_test_p"))


HOLM = f"""te AS (SELECT model, metric, {TAIL} AS p FROM su WHERE metric NOT LIKE '%relative'),
  rk AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p) AS r FROM te WHERE p IS NOT NULL),
  hm AS (SELECT metric, model, least(1.0, max(p * (6 - r + 1)) OVER (PARTITION BY metric ORDER BY r)) AS h
    FROM rk)"""


def endpoints(t):
    """Tested endpoints, written once: the adjustment reads them twice."""
    tests = summary(t).where(~F.col("metric").endswith("relative"))
    return cut_lineage(tests, "endpoints")


@query(
    "f63_holm",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {SUMMARY}, {HOLM}
        SELECT te.model, te.metric, round(p, 9) AS sign_test_p, round(h, 9) AS holm_adjusted_p
        FROM te LEFT JOIN hm ON hm.model = te.model AND hm.metric = te.metric""",
)
def holm(t):
    return P.holm(endpoints(t), ["metric"], "sign_test_p", 6).select(
        "model", "metric", F.round("sign_test_p", 9).alias("sign_test_p"),
        F.round("holm_adjusted_p", 9).alias("holm_adjusted_p"),
    )


@query(
    "g3_holm_over_suppliers",
    "",
    """WITH te AS (SELECT s_suppkey, s_nationkey, (s_suppkey % 37 + 1) / 4000.0 AS p FROM supplier),
       rk AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS r FROM te),
       h AS (SELECT *, least(1.0, max(p * (500 - r + 1)) OVER (PARTITION BY s_nationkey ORDER BY r)) AS a
             FROM rk)
       SELECT s_suppkey, round(max(a) OVER (PARTITION BY s_nationkey, p ORDER BY r
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 9) AS holm_adjusted_p FROM h""",
)
def holm_suppliers(t):
    tests = t.table("supplier").select(
        "s_suppkey", "s_nationkey", ((F.col("s_suppkey") % 37 + 1) / 4000.0).alias("p")
    )
    return P.holm(tests, ["s_nationkey"], "p", 500, overfull=True).select(
        "s_suppkey", F.round("holm_adjusted_p", 9).alias("holm_adjusted_p")
    )


@query(
    "f64_pair_disposition",
    "runs",
    f", {PAIRS} SELECT model, status, count(*) AS pairs FROM de GROUP BY model, status",
)
def disposition(t):
    return P.disposition(deltas(t), ["model"])


# ---------------------------------------------------------------------------
# Usage and cost


def responses(t):
    """Conversation turns as provider responses with four shapes of usage objects."""
    n = F.length("text").cast("bigint")
    k = F.col("conv_id") % 5
    half, tenth = F.floor(n / 2).cast("bigint"), F.floor(n / 10).cast("bigint")

    def shape(*columns):
        return F.to_json(F.struct(*columns))

    details = F.struct(half.alias("cached_tokens"), tenth.alias("cache_write_tokens"))
    listed = F.array(
        F.struct(
            F.struct(
                half.alias("cached_tokens"), tenth.alias("cache_creation_input_tokens")
            ).alias("prompt_tokens_details")
        ),
        F.struct(
            F.struct(
                F.lit(1).alias("cached_tokens"), F.lit(0).alias("cache_creation_input_tokens")
            ).alias("prompt_tokens_details")
        ),
    )
    usage = (
        F.when(k == 0, shape(half.alias("prompt_cache_hit_tokens"), n.alias("prompt_cache_miss_tokens")))
        .when(
            k == 1,
            shape(n.alias("input_tokens"), half.alias("cache_read_input_tokens"),
                  tenth.alias("cache_creation_input_tokens")),
        )
        .when(k == 2, shape(n.alias("input_tokens"), details.alias("input_tokens_details")))
        .when(
            k == 3,
            shape(
                (n + 1).alias("prompt_tokens"),
                F.struct(F.lit(0).alias("cached_tokens")).alias("prompt_tokens_details"),
                listed.alias("x_details"),
            ),
        )
        .otherwise(
            F.when(
                F.col("turn") % 3 < 2,
                shape(n.alias("prompt_tokens"),
                      F.struct(half.alias("cached_tokens")).alias("prompt_tokens_details")),
            ).otherwise(shape(n.alias("prompt_tokens")))
        )
    )
    return t.table("conversations").select("conv_id", "turn", usage.alias("usage"))


BREAKDOWN = """p AS (SELECT conv_id, turn, conv_id % 5 AS k, length(text) AS n FROM conversations),
  s AS (SELECT conv_id, k, turn,
    CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n - n // 2 - n // 10 WHEN 3 THEN n - n // 2 - n // 10
      ELSE CASE WHEN turn % 3 < 2 THEN n - n // 2 ELSE 0 END END AS u,
    CASE k WHEN 3 THEN n // 2 + 1 WHEN 4 THEN CASE WHEN turn % 3 < 2 THEN n // 2 ELSE 0 END
      ELSE n // 2 END AS r,
    CASE WHEN k IN (1, 2, 3) THEN n // 10 ELSE 0 END AS w, NOT (k = 4 AND turn % 3 = 2) AS ok, n FROM p),
  g AS (SELECT conv_id, k, sum(u)::BIGINT AS u, sum(r)::BIGINT AS r, sum(w)::BIGINT AS w,
    bool_and(ok) AS ok, k IN (2, 3) AS ck, sum(n)::BIGINT AS n FROM s GROUP BY conv_id, k)"""


@query(
    "f53_input_breakdown",
    "",
    f"""WITH {BREAKDOWN} SELECT conv_id, u AS uncached_input_tokens, r AS cache_read_input_tokens,
          w AS cache_write_input_tokens, ok AS cache_breakdown_complete, ck AS cache_creation_known FROM g""",
)
def breakdown(t):
    return U.input_breakdown(responses(t), ["conv_id"])


@query(
    "f54_estimated_cost",
    "",
    f"""WITH {BREAKDOWN} SELECT conv_id, CASE WHEN k = 0 THEN NULL
            WHEN conv_id % 7 = 0 AND NOT ck THEN NULL
            WHEN conv_id % 3 > 0 AND NOT ok THEN NULL
            WHEN r > 0 AND conv_id % 3 = 0 THEN NULL
            ELSE round((CASE WHEN ok THEN u ELSE n END * 3.0 + w * 3.75 + r
              * CASE WHEN conv_id % 3 > 0 THEN 0.3 ELSE 0 END + n * 15.0) / 1000000, 9) END AS cost
        FROM g""",
)
def cost(t):
    tokens = t.table("conversations").groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("input_tokens")
    )
    joined = U.input_breakdown(responses(t), ["conv_id"]).join(tokens, "conv_id")
    rated = joined.withColumns(
        {
            "output_tokens": F.col("input_tokens"),
            "cost_available": F.col("conv_id") % 5 > 0,
            "creation_required": F.col("conv_id") % 7 == 0,
            "input_rate": F.lit(3.0),
            "hit_rate": F.when(F.col("conv_id") % 3 > 0, 0.3),
            "write_rate": F.lit(3.75),
            "output_rate": F.lit(15.0),
        }
    )
    return rated.select("conv_id", F.round(U.estimated_cost(), 9).alias("cost"))


OBSERVED = """ob AS (SELECT conv_id, sum(CASE WHEN turn % 3 < 2 THEN n // 2 ELSE 0 END)::BIGINT AS kc,
  sum(CASE WHEN turn % 3 < 2 THEN n - n // 2 ELSE 0 END)::BIGINT AS ku,
  sum(CASE WHEN turn % 3 = 2 THEN n ELSE 0 END)::BIGINT AS un, sum(turn + 1)::BIGINT AS o
  FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) GROUP BY conv_id)"""


def observed(t):
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("bigint")
    total = (n + F.col("turn") + 1).alias("total_tokens")
    usage = F.when(
        F.col("turn") % 3 < 2,
        F.to_json(
            F.struct(
                n.alias("prompt_tokens"), total,
                F.struct(half.alias("cached_tokens")).alias("prompt_tokens_details"),
            )
        ),
    ).otherwise(F.to_json(F.struct(n.alias("prompt_tokens"), total)))
    rows = t.table("conversations").select("conv_id", usage.alias("usage"))
    return U.cache_observation(rows, ["conv_id"])


BOUNDED = f"""{OBSERVED}, bo AS (SELECT conv_id, 'm' || (conv_id % 3) AS model, 'a' || (conv_id % 2) AS treatment,
  (kc * 0.3 + ku * 3.0 + o * 15.0) / 1000000 + un * 0.3 / 1000000 AS lo,
  (kc * 0.3 + ku * 3.0 + o * 15.0) / 1000000 + un * 3.0 / 1000000 AS hi FROM ob)"""


def bounded(t):
    rated = observed(t).withColumns(
        {
            "input_rate": F.lit(3.0), "hit_rate": F.lit(0.3), "output_rate": F.lit(15.0),
            "model": F.concat(F.lit("m"), F.col("conv_id") % 3),
            "treatment": F.concat(F.lit("a"), F.col("conv_id") % 2), "currency": F.lit("USD"),
        }
    )
    return U.cost_bounds(rated)


@query(
    "f55_cache_observation",
    "",
    f"""WITH {OBSERVED} SELECT conv_id, kc AS known_cached, ku AS known_uncached, un AS unknown_cache,
          o AS output_tokens FROM ob""",
)
def cache_observation(t):
    return observed(t)


@query(
    "f55_cost_bounds",
    "",
    f"""WITH {BOUNDED} SELECT model, treatment, 'USD' AS currency, round(sum(lo), 9) AS cost_low,
          round(sum(hi), 9) AS cost_high FROM bo GROUP BY model, treatment""",
)
def cost_bounds(t):
    return U.bounded_costs(bounded(t)).select(
        "model", "treatment", "currency", F.round("cost_low", 9).alias("cost_low"),
        F.round("cost_high", 9).alias("cost_high"),
    )


@query(
    "f56_usage_totals",
    "runs",
    """SELECT case_id, CASE WHEN count(input_tokens) = count(*) THEN sum(input_tokens)::BIGINT END AS input_tokens,
         CASE WHEN count(rows_returned) = count(*) THEN sum(rows_returned)::BIGINT END AS rows_returned,
         sum(output_tokens)::BIGINT AS output_tokens,
         CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency,
         bool_and(typed_evidence) AS cache_breakdown_complete FROM runs GROUP BY case_id""",
)
def usage_totals(t):
    rows = t.runs.withColumn("cache_breakdown_complete", F.col("typed_evidence"))
    return U.usage_totals(rows, ["case_id"], ["input_tokens", "rows_returned", "output_tokens"])


# Frozen exchange rates.
UNITS_PER_USD = {"USD": 1.0, "CNY": 6.7179}


def usd_rates(t):
    """Rates per currency, for the currencies which the runs are billed in."""
    currency = F.col("currency")
    rate = F.lit(None).cast("double")
    for name, units in UNITS_PER_USD.items():
        rate = F.when(currency == name, 1.0 / units).otherwise(rate)
    return t.runs.select("currency").distinct().select("currency", rate.alias("per_unit_usd"))


PRICED = """pm AS (SELECT model, CASE WHEN count(cost) = count(*) AND count(DISTINCT currency) = 1
  THEN min(currency) END AS cur FROM runs GROUP BY model)"""


@query(
    "f57_usage_by_treatment",
    "runs",
    f""", {PRICED} SELECT treatment, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens,
          sum(output_tokens)::BIGINT AS output_tokens,
          count(DISTINCT CASE WHEN cur IS NOT NULL THEN runs.model END) AS priced_models,
          round(sum(CASE WHEN cur = 'USD' THEN cost WHEN cur = 'CNY' THEN cost / 6.7179 END), 4)
            AS estimated_cost_usd
        FROM runs JOIN pm ON pm.model = runs.model GROUP BY treatment""",
)
def usage_by_treatment(t):
    return U.usage_by_treatment(t.runs, usd_rates(t)).withColumn(
        "estimated_cost_usd", F.round("estimated_cost_usd", 4)
    )


@query(
    "f57_spend_by_currency",
    "runs",
    f""", {PRICED} SELECT treatment, cur AS currency, round(sum(cost), 4) AS spend FROM runs
          JOIN pm ON pm.model = runs.model WHERE cur IS NOT NULL GROUP BY treatment, cur""",
)
def spend(t):
    return U.spend_by_currency(t.runs).withColumn("spend", F.round("spend", 4))


COST_REPORT = """cr AS (SELECT model, CASE WHEN count(cost) = count(*) THEN sum(cost) END AS cost,
  CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency,
  model <> 'm1' AS avail, model <> 'm2' AS comp
  FROM (SELECT model, currency, CASE WHEN model <> 'm1' THEN cost END AS cost FROM runs) GROUP BY model)"""


def cost_parts(t):
    rows = t.runs.withColumns(
        {
            "cost": F.when(F.col("model") != "m1", F.col("cost")),
            "cost_available": F.col("model") != "m1",
            "breakdown_complete": F.col("model") != "m2",
        }
    )
    return rows.select("model", "treatment", "cost", "currency", "cost_available", "breakdown_complete")


@query(
    "f58_cost_report",
    "runs",
    f""", {COST_REPORT} SELECT model, CASE WHEN cost IS NOT NULL AND currency IS NOT NULL THEN 'available'
          ELSE 'not_estimable' END AS status, round(cost, 4) AS estimated_cost, currency,
          CASE WHEN cost IS NOT NULL AND currency IS NOT NULL THEN NULL WHEN NOT avail
            THEN 'model_price_not_frozen' WHEN NOT comp THEN 'cache_breakdown_incomplete'
            ELSE 'usage_not_priceable' END AS reason_code FROM cr""",
)
def cost_report(t):
    return U.cost_report(cost_parts(t)).withColumn("estimated_cost", F.round("estimated_cost", 4))


@query(
    "f58_cost_totals",
    "runs",
    f""", {COST_REPORT} SELECT currency, round(sum(cost), 4) AS known_total FROM cr
          WHERE cost IS NOT NULL GROUP BY currency""",
)
def cost_totals(t):
    return U.cost_totals(U.cost_report(cost_parts(t))).withColumn(
        "known_total", F.round("known_total", 4)
    )


@query(
    "f58_cross_currency_total",
    "runs",
    """SELECT round(sum(CASE WHEN currency = 'USD' THEN cost ELSE cost / 6.7179 END), 4) AS usd_total
       FROM runs WHERE model NOT IN ('m1', 'm2')""",
)
def cross_currency(t):
    priced = cost_parts(t).where(~F.col("model").isin("m1", "m2"))
    total = U.cross_currency_total(U.cost_report(priced), usd_rates(t))
    return total.withColumn("usd_total", F.round("usd_total", 4))


@query(
    "f58_family_cost_agreement",
    "runs",
    """, f AS (SELECT model, treatment, sum(output_tokens) AS c, 'a' AS fam FROM runs WHERE treatment <> 'graph'
              GROUP BY model, treatment UNION ALL
              SELECT model, treatment, sum(output_tokens) + CASE WHEN model = 'm1' AND treatment = 'raw'
                THEN 1 ELSE 0 END, 'b' FROM runs WHERE treatment <> 'split' GROUP BY model, treatment)
       SELECT model, treatment, count(*) AS families FROM f GROUP BY model, treatment
       HAVING min(c) < max(c)""",
)
def agreement(t):
    total = t.runs.groupBy("model", "treatment").agg(F.sum("output_tokens").alias("cost"))
    moved = (F.col("model") == "m1") & (F.col("treatment") == "raw")
    first = total.where(F.col("treatment") != "graph")
    second = total.where(F.col("treatment") != "split").withColumn(
        "cost", F.col("cost") + F.when(moved, 1).otherwise(0)
    )
    return U.family_cost_agreement(first.unionByName(second)).select(
        "model", "treatment", "families"
    )


# ---------------------------------------------------------------------------
# Reporting


def coded_citations(t):
    doc = F.col("ordinal")
    none = F.array().cast("array<string>")
    return t.citations.select(
        F.when(F.col("run_id") % 2 == 0, "raw").otherwise("graph").alias("treatment"),
        "claim_types",
        F.when(doc % 3 == 0, F.array(F.lit("result_incomplete"), F.lit("lineage_unproven")))
        .otherwise(none).alias("baseline_codes"),
        F.when(doc % 5 == 0, F.array(F.lit("lineage_unproven"), F.lit("period_not_covered")))
        .otherwise(none).alias("anomaly_codes"),
    )


@query(
    "f65_rejection_counts",
    "citations",
    """, x AS (SELECT CASE WHEN run_id % 2 = 0 THEN 'raw' ELSE 'graph' END AS treatment,
              list_contains(claim_types, 'fault_mechanism') AS c, ordinal AS o FROM citations),
       y AS (SELECT treatment, c, 'result_incomplete' AS code FROM x WHERE o % 3 = 0
             UNION ALL SELECT treatment, c, 'lineage_unproven' FROM x WHERE o % 3 = 0 OR o % 5 = 0
             UNION ALL SELECT treatment, c, 'period_not_covered' FROM x WHERE o % 5 = 0)
       SELECT treatment, code, count(CASE WHEN c THEN 1 END) AS claiming,
         count(CASE WHEN NOT c THEN 1 END) AS not_claiming FROM y GROUP BY treatment, code""",
)
def rejections(t):
    return R.rejection_counts(coded_citations(t))


@query(
    "f66_mechanism_effects",
    "runs case_table",
    f""", {PAIRS}, {EFFECTS} SELECT model, mechanism_code, metric, count(*) AS eligible_cases,
          round(median(case_median), 6) AS case_median_delta,
          count(CASE WHEN case_median < 0 THEN 1 END) AS negative_cases,
          count(CASE WHEN case_median = 0 THEN 1 END) AS tied_cases,
          count(CASE WHEN case_median > 0 THEN 1 END) AS positive_cases
        FROM ce JOIN case_table USING (case_id) GROUP BY model, mechanism_code, metric""",
)
def mechanism_effects(t):
    named = R.with_context(effects(t), t.case_table)
    return R.grouped_effects(named, ["model", "mechanism_code"]).withColumn(
        "case_median_delta", F.round("case_median_delta", 6)
    )


@query(
    "f66_group_currency",
    "runs case_table",
    """SELECT mechanism_code, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency
       FROM runs JOIN case_table USING (case_id)
       WHERE cost IS NOT NULL AND NOT (case_id % 2 = 0 AND model = 'm3') GROUP BY mechanism_code""",
)
def currency(t):
    rows = R.with_context(t.runs, t.case_table).where(
        F.col("cost").isNotNull() & ~((F.col("case_id") % 2 == 0) & (F.col("model") == "m3"))
    )
    return R.group_currency(rows, ["mechanism_code"])


RESOURCES = ["output_tokens", "cost"]


@query(
    "f67_resource_effects",
    "runs",
    """, d AS (SELECT b.model, b.case_id, t.output_tokens - b.output_tokens AS o, t.cost - b.cost AS c
              FROM runs b JOIN runs t ON b.model = t.model AND b.case_id = t.case_id
               AND b.repetition = t.repetition AND b.treatment = 'raw' AND t.treatment = 'graph'
              WHERE b.eligible AND t.eligible)
       SELECT model, case_id, 'output_tokens' AS metric, median(o::DOUBLE) AS case_median FROM d GROUP BY ALL
       UNION ALL SELECT model, case_id, 'cost', round(median(c), 6) FROM d WHERE c IS NOT NULL GROUP BY ALL""",
)
def resources(t):
    return R.resource_effects(t.runs, RESOURCES, "raw", "graph").withColumn(
        "case_median", F.round("case_median", 6)
    )


ACTUAL = """ac AS (SELECT r.model, r.case_id, treatment, CASE WHEN count(cost) = min(n) THEN sum(cost) END AS c
  FROM runs r JOIN (SELECT model, case_id, count(DISTINCT repetition) AS n FROM runs GROUP BY ALL) k
    ON k.model = r.model AND k.case_id = r.case_id
  WHERE treatment IN ('raw', 'graph') GROUP BY r.model, r.case_id, treatment)"""


@query(
    "f67_actual_costs",
    "runs",
    f""", {ACTUAL} SELECT model, case_id, treatment, round(c, 4) AS actual_cost FROM ac""",
)
def actual(t):
    return R.actual_costs(t.runs, ("raw", "graph")).withColumn(
        "actual_cost", F.round("actual_cost", 4)
    )


@query(
    "f67_model_costs",
    "runs",
    f""", {ACTUAL} SELECT model, treatment, CASE WHEN count(c) = count(*) THEN round(sum(c), 4) END
            AS actual_cost FROM ac GROUP BY model, treatment""",
)
def model_costs(t):
    return R.model_costs(R.actual_costs(t.runs, ("raw", "graph"))).withColumn(
        "actual_cost", F.round("actual_cost", 4)
    )


@query(
    "f68_case_outcomes",
    "runs",
    f""", {PAIRS}, {EFFECTS} SELECT case_id,
          count(CASE WHEN metric = 'rows_returned' THEN 1 END) AS measured_rows_returned,
          count(CASE WHEN metric = 'rows_returned' AND case_median < 0 THEN 1 END) AS fewer_rows_returned,
          count(CASE WHEN metric = 'tool_calls' THEN 1 END) AS measured_tool_calls,
          count(CASE WHEN metric = 'tool_calls' AND case_median < 0 THEN 1 END) AS fewer_tool_calls
        FROM ce GROUP BY case_id""",
)
def outcomes(t):
    return R.case_outcomes(effects(t), ["rows_returned", "tool_calls"])


CELLS = """cl AS (SELECT causal_scope, treatment, model, count(*) AS runs,
  count(CASE WHEN diagnosis_correct THEN 1 END) AS correct
  FROM runs JOIN case_table USING (case_id) GROUP BY causal_scope, treatment, model)"""


def cells(t):
    return R.correct_by(R.with_context(t.runs, t.case_table), "causal_scope")


@query(
    "f69_correct_by_scope",
    "runs case_table",
    f""", {CELLS} SELECT * FROM cl UNION ALL SELECT causal_scope, treatment, 'all', sum(runs)::BIGINT,
            sum(correct)::BIGINT FROM cl GROUP BY causal_scope, treatment""",
)
def correct_by_scope(t):
    return cells(t)


KINDS = """len(list_distinct(list_transform(base_tables, lambda b: CASE lower(b) WHEN 'logs' THEN 'log'
  WHEN 'traces' THEN 'trace' ELSE 'metric' END))) > 1"""


@query(
    "f70_tool_use",
    "calls",
    f""", x AS (SELECT treatment, run_id, failed,
            NOT failed AND tool_name = 'execute_sql' AND regexp_matches(sql_text, '(?i)\\bJOIN\\b') AS j,
            {KINDS} AS kinds, NOT failed AND tool_name = 'query_metrics' AND operation = 'query_range' AS ev,
            NOT failed AND tool_name = 'query_semantic_graph' AS g FROM calls)
        SELECT treatment, count(DISTINCT run_id) AS runs, count(*) AS tool_calls,
          count(CASE WHEN NOT failed THEN 1 END) AS successful_calls, count(CASE WHEN j THEN 1 END) AS join_calls,
          count(DISTINCT CASE WHEN j THEN run_id END) AS runs_with_join,
          count(CASE WHEN j AND kinds THEN 1 END) AS cross_signal_calls,
          count(DISTINCT CASE WHEN j AND kinds THEN run_id END) AS runs_with_cross_signal,
          count(DISTINCT CASE WHEN ev THEN run_id END) AS runs_with_metric_evaluation,
          count(CASE WHEN g THEN 1 END) AS graph_calls,
          count(DISTINCT CASE WHEN g THEN run_id END) AS runs_with_graph_call
        FROM x GROUP BY treatment""",
)
def tool_use(t):
    return R.tool_use(t.calls)


@query(
    "f70_tool_call_counts",
    "calls",
    """SELECT treatment, tool_name, count(*) AS calls, count(CASE WHEN NOT failed THEN 1 END) AS successes
       FROM calls GROUP BY treatment, tool_name""",
)
def tool_calls(t):
    return R.tool_call_counts(t.calls)


@query(
    "f71_citation_submission",
    "runs",
    """SELECT model, count(*) AS runs, count(CASE WHEN cited_evidence_count = 0 THEN 1 END)
         AS runs_without_citation, count(CASE WHEN cited_evidence_count = 0 AND diagnosis_correct THEN 1 END)
         AS correct_lost FROM runs GROUP BY model""",
)
def submission(t):
    return R.citation_submission(t.runs)


SCORE = """sc AS (SELECT {keys}, count(*) AS runs,
  sum(CASE WHEN causal_scope_match THEN 10 ELSE 0 END + CASE WHEN causal_locus_match THEN 30 ELSE 0 END) AS l,
  sum(CASE WHEN fault_category_match THEN 10 ELSE 0 END + CASE WHEN mechanism_code_match THEN 30 ELSE 0 END) AS c,
  sum(CASE WHEN valid_evidence_count > 0 THEN 5 ELSE 0 END) AS e,
  count(CASE WHEN required_evidence_covered THEN 1 END) AS covered,
  count(CASE WHEN NOT required_evidence_covered THEN 1 END) AS failed,
  count(CASE WHEN required_evidence_covered IS NULL THEN 1 END) AS not_estimable
  FROM runs GROUP BY {keys})"""
SCORED = """SELECT {keys}, runs, (l + c + e)::BIGINT AS points, round((l + c + e) / runs, 2) AS score,
  round(100 * (l + c + e) / (runs * 85), 2) AS normalized_score, round(l / runs, 2) AS average_location,
  round(c / runs, 2) AS average_root_cause, round(e / runs, 2) AS average_evidence, covered, failed,
  not_estimable FROM sc"""


@query(
    "f72_capability_scores",
    "runs",
    f", {SCORE.format(keys='model, treatment')} {SCORED.format(keys='model, treatment')}",
)
def capability(t):
    return R.capability_scores(t.runs, ["model", "treatment"])


@query(
    "g6_capability_ranking",
    "runs",
    f""", {SCORE.format(keys='model')}, so AS ({SCORED.format(keys='model')})
        SELECT model, normalized_score, row_number() OVER (ORDER BY normalized_score DESC, model) AS rank
        FROM so""",
)
def capability_ranking(t):
    from faultline.operators.selection import score_ranking

    scores = R.capability_scores(t.runs, ["model"]).select("model", "normalized_score")
    return score_ranking(scores, "model", "normalized_score")


@query(
    "f73_family_tally",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {SUMMARY}, {HOLM},
        en AS (SELECT su.metric, su.model, coalesce(h < 0.05, false) AS ok,
                 sign(positive_cases - negative_cases) AS d
               FROM su LEFT JOIN hm ON hm.model = su.model AND hm.metric = su.metric
               WHERE su.metric NOT LIKE '%relative')
        SELECT metric, count(*) AS total, count(CASE WHEN ok THEN 1 END) AS confirmed,
          count(CASE WHEN d < 0 THEN 1 END) AS favouring_treatment,
          count(CASE WHEN d > 0 THEN 1 END) AS favouring_baseline,
          count(CASE WHEN d = 0 THEN 1 END) AS no_direction,
          CASE WHEN count(CASE WHEN ok THEN 1 END) = count(*) THEN 'supported'
               WHEN count(CASE WHEN ok THEN 1 END) > 0 THEN 'partially_supported' ELSE 'not_supported' END
            AS status FROM en GROUP BY metric""",
)
def tally(t):
    return R.family_tally(P.holm(endpoints(t), ["metric"], "sign_test_p", 6), "metric")


def arm_values(t):
    """Per case: correct diagnoses (higher is better) and rows (lower is better) of every arm."""
    grouped = t.runs.groupBy("case_id", "treatment").agg(
        F.count_if(F.col("diagnosis_correct") & (F.col("repetition") < 3)).alias("correct"),
        F.sum("rows_returned").alias("rows"),
    )
    known = F.when((F.col("case_id") % 5 > 0) | (F.col("treatment") != "raw"), F.col("rows"))
    pick = F.explode(
        F.array(
            F.struct(F.lit("higher").alias("better"), F.col("correct").alias("value")),
            F.struct(F.lit("lower").alias("better"), known.alias("value")),
        )
    )
    return grouped.select("case_id", "treatment", pick.alias("p")).select(
        F.concat_ws("-", F.col("case_id").cast("string"), "p.better").alias("row_id"),
        "treatment", "p.better", "p.value",
    )


@query(
    "f74_arm_ratios",
    "runs",
    """, g AS (SELECT case_id, treatment, count(CASE WHEN diagnosis_correct AND repetition < 3 THEN 1 END) AS c,
              sum(rows_returned)::BIGINT AS r FROM runs GROUP BY case_id, treatment),
       a AS (SELECT case_id || '-higher' AS row_id, treatment, 'higher' AS better, c AS value FROM g UNION ALL
             SELECT case_id || '-lower', treatment, 'lower',
               CASE WHEN case_id % 5 > 0 OR treatment <> 'raw' THEN r END FROM g),
       s AS (SELECT row_id, max(value) AS w, CASE WHEN min(better) = 'higher' THEN max(value) ELSE min(value) END
               AS ref FROM a GROUP BY row_id)
       SELECT a.row_id, treatment, value, ref AS reference,
         (SELECT min(treatment) FROM a x WHERE x.row_id = a.row_id AND x.value = s.ref) AS best,
         round(CASE WHEN ref <> 0 THEN value / ref END, 6) AS ratio,
         round(CASE WHEN w <> 0 THEN coalesce(value, 0) / w ELSE 0 END, 6) AS fraction
       FROM a JOIN s ON s.row_id = a.row_id""",
)
def ratios(t):
    return R.arm_ratios(arm_values(t), "row_id", "treatment", "value", "better").select(
        "row_id", "treatment", "value", "reference", "best", F.round("ratio", 6).alias("ratio"),
        F.round("fraction", 6).alias("fraction"),
    )


@query(
    "f74_interval_ratios",
    "runs",
    """, i AS (SELECT case_id, treatment, sum(output_tokens)::BIGINT AS low,
              sum(output_tokens)::BIGINT + count(*) * (case_id % 3) * 100 AS high FROM runs
              GROUP BY case_id, treatment),
       r AS (SELECT case_id, min(low) AS lo, min(high) AS hi FROM i GROUP BY case_id),
       j AS (SELECT i.*, lo, hi, coalesce(high <= (SELECT min(x.low) FROM i x WHERE x.case_id = i.case_id
               AND x.treatment <> i.treatment), true) AS cheapest FROM i JOIN r ON r.case_id = i.case_id)
       SELECT case_id, treatment, low, high,
         round(CASE WHEN cheapest THEN 1.0 WHEN lo > 0 THEN greatest(1.0, low / hi) END, 6) AS ratio_low,
         round(CASE WHEN cheapest THEN 1.0 WHEN lo > 0 THEN high / lo END, 6) AS ratio_high FROM j""",
)
def intervals(t):
    rows = t.runs.groupBy("case_id", "treatment").agg(
        F.sum("output_tokens").alias("low"),
        (F.sum("output_tokens") + F.count(F.lit(1)) * F.max(F.col("case_id") % 3) * 100).alias("high"),
    )
    return R.interval_ratios(rows, "case_id", "treatment").select(
        "case_id", "treatment", "low", "high", F.round("ratio_low", 6).alias("ratio_low"),
        F.round("ratio_high", 6).alias("ratio_high"),
    )


@query(
    "f75_accuracy_rates",
    "runs case_table",
    f""", {CELLS} SELECT causal_scope, treatment, sum(correct)::BIGINT AS correct, sum(runs)::BIGINT AS runs,
          round(sum(correct) / sum(runs), 6) AS rate FROM cl GROUP BY causal_scope, treatment""",
)
def accuracy(t):
    per_model = cells(t).where(F.col("model") != "all")
    return R.accuracy_rates(per_model, ["causal_scope", "treatment"]).withColumn(
        "rate", F.round("rate", 6)
    )


@query(
    "f75_headline_reductions",
    "runs",
    """, x AS (SELECT sum(CASE WHEN treatment = 'split' AND NOT diagnosis_correct THEN 1 ELSE 0 END)::BIGINT AS wb,
           sum(CASE WHEN treatment = 'raw' AND NOT diagnosis_correct THEN 1 ELSE 0 END)::BIGINT AS wt,
           sum(CASE WHEN treatment = 'split' THEN coalesce(input_tokens, 0) ELSE 0 END) AS tb,
           sum(CASE WHEN treatment = 'raw' THEN coalesce(input_tokens, 0) ELSE 0 END) AS tt FROM runs)
       SELECT wb AS baseline_wrong, wt AS treatment_wrong, round((wb - wt) / wb, 9) AS wrong_reduction,
         round((tb - tt) / tb, 9) AS token_reduction FROM x""",
)
def headline(t):
    rows = R.headline_reductions(t.runs, "split", "raw")
    return rows.withColumns(
        {c: F.round(c, 9) for c in ("wrong_reduction", "token_reduction")}
    )


@query(
    "f76_reliability",
    "runs",
    """SELECT model, treatment, count(*) AS runs, count(CASE WHEN runner_error THEN 1 END) AS runner_errors,
         count(CASE WHEN tool_budget_exhausted THEN 1 END) AS budget_exhaustions,
         sum(failed_queries)::BIGINT AS failed_queries, sum(rejected_calls)::BIGINT AS rejected_calls
       FROM runs GROUP BY model, treatment""",
)
def reliability(t):
    return R.reliability(t.runs, ["model", "treatment"])


@query(
    "f77_sample_range",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {SUMMARY} SELECT min(eligible_cases) AS smallest_sample,
          max(eligible_cases) AS largest_sample FROM su""",
)
def sample_range(t):
    return R.sample_range(summary(t))


@query(
    "f78_position_balance",
    "",
    """WITH c AS (SELECT o_custkey, o_orderstatus AS arm, o_orderkey % 3 AS pos, count(*) AS n FROM orders
           GROUP BY ALL),
       a AS (SELECT o_custkey, count(DISTINCT arm) AS k FROM c GROUP BY o_custkey),
       f AS (SELECT a.o_custkey, k, arms.arm, p.pos, coalesce(c.n, 0) AS n FROM a
             JOIN (SELECT DISTINCT o_custkey, arm FROM c) arms ON arms.o_custkey = a.o_custkey
             JOIN (VALUES (0), (1), (2)) p(pos) ON p.pos < k
             LEFT JOIN c ON c.o_custkey = a.o_custkey AND c.arm = arms.arm AND c.pos = p.pos)
       SELECT o_custkey, bool_and(k <= 1 OR lo = hi) AS balanced
       FROM (SELECT o_custkey, k, arm, min(n) AS lo, max(n) AS hi FROM f GROUP BY ALL) GROUP BY o_custkey""",
)
def balance(t):
    rows = t.table("orders").withColumn("pos", F.col("o_orderkey") % 3)
    return R.position_balance(rows, "o_custkey", "o_orderstatus", "pos")


@query(
    "f79_success_pairs",
    "runs",
    """, b AS (SELECT * FROM runs WHERE treatment = 'split'), t AS (SELECT * FROM runs WHERE treatment = 'raw')
       SELECT b.model, count(*) AS paired_observations,
         count(CASE WHEN t.diagnosis_correct AND NOT b.diagnosis_correct THEN 1 END) AS improvements,
         count(CASE WHEN b.diagnosis_correct AND NOT t.diagnosis_correct THEN 1 END) AS regressions,
         count(CASE WHEN b.diagnosis_correct = t.diagnosis_correct THEN 1 END) AS ties
       FROM b JOIN t ON b.model = t.model AND b.case_id = t.case_id AND b.repetition = t.repetition
       GROUP BY b.model""",
)
def success(t):
    return P.success_pairs(pairs(t, ["diagnosis_correct"]), ["model"], "diagnosis_correct")


@query(
    "f80_merged_cohorts",
    "runs",
    f""", {SCORE.format(keys='model')}, so AS ({SCORED.format(keys='model')})
        SELECT model, normalized_score, model = 'm2' AS shared_model, model IN ('m2', 'm3') AS mixed_contract
        FROM so""",
)
def merged(t):
    contract = F.when(
        (F.col("model") == "m3") & (F.col("repetition") == 7), "v2"
    ).otherwise("v1")
    rows = t.runs.withColumn("contract", contract)
    two = F.col("model") == "m2"
    first = rows.where(F.col("model").isin("m0", "m1") | (two & (F.col("case_id") % 2 == 0)))
    second = rows.where((F.col("model") == "m3") | (two & (F.col("case_id") % 2 == 1)))
    second = second.withColumn("contract", F.when(two, "v2").otherwise(F.col("contract")))
    joined = R.merge_cohorts(first, second, ["contract"])
    scores = R.capability_scores(joined, ["model", "shared_model", "mixed_contract"])
    return scores.select("model", "normalized_score", "shared_model", "mixed_contract")


@query(
    "f81_direction_by_model",
    "runs case_table",
    f""", {PAIRS}, {EFFECTS}, m AS (SELECT model, mechanism_code, median(case_median) AS d FROM ce
          JOIN case_table USING (case_id) WHERE metric = 'rows_returned' GROUP BY ALL)
        SELECT mechanism_code, count(CASE WHEN d < 0 THEN 1 END) AS improved_models,
          count(CASE WHEN d = 0 THEN 1 END) AS tied_models, count(CASE WHEN d > 0 THEN 1 END) AS regressed_models
        FROM m GROUP BY mechanism_code""",
)
def by_model(t):
    named = R.with_context(effects(t), t.case_table).where(F.col("metric") == "rows_returned")
    grouped = R.grouped_effects(named, ["model", "mechanism_code"])
    return R.direction_by_model(grouped, ["mechanism_code"], "case_median_delta")


@query(
    "f88_completeness",
    "runs",
    """, s AS (SELECT DISTINCT m.model, c.s_suppkey AS case_id, r.repetition, t.treatment
              FROM (SELECT DISTINCT model FROM runs) m, supplier c, (SELECT DISTINCT repetition FROM runs) r,
                   (SELECT DISTINCT treatment FROM runs) t)
       SELECT count(*) AS expected_cells, count(x.run_id) AS completed_cells,
         count(CASE WHEN x.runner_error THEN 1 END) AS runner_errors,
         count(CASE WHEN x.tool_budget_exhausted THEN 1 END) AS budget_exhaustions,
         count(*) = count(x.run_id) AS complete
       FROM s LEFT JOIN runs x ON x.model = s.model AND x.case_id = s.case_id
        AND x.repetition = s.repetition AND x.treatment = s.treatment""",
)
def completeness(t):
    # Every case is scheduled for four models, seven repetitions and three arms.
    grid = {
        "model": [F.lit(f"m{i}") for i in range(4)],
        "repetition": [F.lit(i) for i in range(1, 8)],
        "treatment": [F.lit(a) for a in ("split", "raw", "graph")],
    }
    schedule = t.case_table.select("case_id")
    for name, values in grid.items():
        schedule = schedule.withColumn(name, F.explode(F.array(*values)))
    return R.completeness(schedule, t.runs, [*KEYS, "treatment"])


@query(
    "f89_concurrency_deviations",
    "runs",
    """SELECT run_id, failed_queries AS concurrency_limit, 4 AS frozen_limit FROM runs
       WHERE failed_queries > 4 AND rejected_calls > 0""",
)
def deviations(t):
    limit = F.when(F.col("rejected_calls") > 0, F.col("failed_queries"))
    rows = t.runs.select("run_id", limit.alias("concurrency_limit"))
    return R.concurrency_deviations(rows, 4)


@query(
    "f90_cohort_sizes",
    "case_table",
    "SELECT mechanism_code, count(*) AS cases FROM case_table GROUP BY mechanism_code",
)
def cohort(t):
    return R.cohort_sizes(t.case_table, "mechanism_code")


@query(
    "f92_retry_ledger",
    "",
    """WITH a AS (SELECT l_orderkey AS cell, l_linenumber AS attempt, l_partkey AS record FROM lineitem),
       u AS (SELECT record FROM a GROUP BY record HAVING count(*) > 33)
       SELECT cell, count(*) AS attempts,
         count(*) = max(attempt) AND count(DISTINCT attempt) = max(attempt) AND min(attempt) = 1
           AND max(attempt) <= 3 AS sequence_valid,
         bool_or(a.record IN (SELECT record FROM u)) AS record_reused FROM a GROUP BY cell""",
)
def ledger(t):
    # Part keys repeat; only those used very often count as one record used twice.
    rows = t.table("lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("attempt"),
        F.col("l_partkey").alias("part"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey",
                                                             "l_extendedprice")]).alias("own"),
    )
    often = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 33").select(
        "part", F.lit(True).alias("often")
    )
    named = rows.join(often, "part", "left").withColumn(
        "record", F.when(F.col("often"), F.col("part").cast("string")).otherwise(F.col("own"))
    )
    return R.retry_ledger(named)


@query(
    "f92_retained_failures",
    "runs",
    """, f AS (SELECT run_id AS cell FROM runs WHERE runner_error),
       k AS (SELECT run_id AS cell, 1 + (output_tokens % 10 = 0)::INTEGER AS n FROM runs
             WHERE (runner_error AND output_tokens % 7 > 0) OR tool_budget_exhausted)
       SELECT coalesce(f.cell, k.cell) AS cell, coalesce(k.n, 0)::BIGINT AS records, f.cell IS NOT NULL AS failed
       FROM f FULL OUTER JOIN k ON f.cell = k.cell WHERE f.cell IS NULL OR k.cell IS NULL OR k.n > 1""",
)
def retained(t):
    failed = t.runs.where("runner_error").select(F.col("run_id").alias("cell"))
    p = F.col("output_tokens")
    kept = t.runs.where(
        (F.col("runner_error") & (p % 7 > 0)) | F.col("tool_budget_exhausted")
    )
    copies = F.when(p % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = kept.select(F.col("run_id").alias("cell"), F.explode(copies).alias("copy"))
    return R.retained_failures(failed, rows)


@query(
    "f93_result_sizes",
    "",
    r"""SELECT conv_id, count(*) AS returned_items,
         (strlen('{"columns":["turn","role","text"],"rows":[]}') + count(*) - 1
          + sum(strlen('[' || turn || ',"' || role || '",""]') + len(text)
            + len(regexp_replace(text, '[^"\\\n\r\t]', '', 'g'))
            + 5 * len(regexp_replace(text, '[\x00-\x7e]', '', 'g'))))::BIGINT AS result_bytes
       FROM conversations GROUP BY conv_id""",
)
def sizes(t):
    return R.result_sizes(t.table("conversations"), ["conv_id"], ["turn", "role", "text"])


RELATIVE = f"""re AS (SELECT model, count(*) AS cases, median(case_median) * 100.0 AS percent FROM ce
  WHERE metric = 'input_tokens_relative' GROUP BY model)"""


def relative(t):
    return P.relative_by_model(effects(t), ["model"], "input_tokens")


@query(
    "f94_relative_by_model",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {RELATIVE} SELECT model, cases, round(percent, 6) AS percent FROM re""",
)
def relative_by_model(t):
    return relative(t).withColumn("percent", F.round("percent", 6))


@query(
    "f94_reduction_counts",
    "runs",
    f""", {PAIRS}, {EFFECTS}, {RELATIVE} SELECT 'input_tokens' AS metric, count(percent) AS models,
          count(CASE WHEN percent < 0 THEN 1 END) AS reduced,
          round(min(CASE WHEN percent < 0 THEN -percent END), 6) AS smallest,
          round(max(CASE WHEN percent < 0 THEN -percent END), 6) AS largest FROM re""",
)
def reductions(t):
    rows = relative(t).withColumn("metric", F.lit("input_tokens"))
    return P.reduction_counts(rows, ["metric"]).withColumns(
        {c: F.round(c, 6) for c in ("smallest", "largest")}
    )


@query(
    "f94_scope_contrast",
    "runs case_table",
    f""", {CELLS}, m AS (SELECT model, sum(CASE WHEN treatment = 'graph' THEN correct END) AS g,
            sum(CASE WHEN treatment = 'raw' THEN correct END) AS r FROM cl
          WHERE causal_scope <> 'infrastructure_node' GROUP BY model)
        SELECT count(*) AS models, count(CASE WHEN g > r THEN 1 END) AS better,
          count(CASE WHEN g < r THEN 1 END) AS worse FROM m""",
)
def contrast(t):
    rows = cells(t).where(
        (F.col("model") != "all") & (F.col("causal_scope") != "infrastructure_node")
    )
    return R.scope_contrast(rows, "graph", "raw")


def lineitem_records(t):
    """Recorded runs as nested documents: the lines of a supplier and line number, as calls."""
    def call(line, at):
        # An order may hold two equal lines; each is a call of its own.
        k, name = line["k"], F.concat(F.lit("q"), line["k"], F.lit("-"), at)
        return F.struct(
            name.alias("query_id"), F.lit("execute_sql").alias("tool_name"),
            F.create_map(F.lit("query"), F.lit("SELECT 1")).alias("input"),
            F.struct(
                F.when(k % 13 == 0, "other").otherwise(name).alias("query_id"),
                (k % 11 == 0).alias("truncated"),
            ).alias("output"),
            F.when(k % 9 == 0, "timeout").alias("error"),
            F.when(k % 8 > 0, F.array(F.lit("logs"))).alias("base_tables"),
            F.struct(line["quantity"].cast("bigint").alias("rows_returned")).alias("database_load"),
        )

    k, arms = F.col("l_orderkey"), F.array(F.lit("split"), F.lit("raw"), F.lit("graph"))
    lines = t.table("lineitem").select(
        (F.col("l_partkey") % 4).alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_linenumber").alias("repetition"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("arm"),
        k.alias("k"), F.col("l_quantity").alias("quantity"),
    )
    # Lines are shuffled as numbers, and before they fold: a run has few, and a fold of one is longer than it.
    keys = ["part", "supplier", "repetition", "arm"]
    runs = lines.repartition(*keys).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "quantity"))), call).alias("calls"),
        F.sum("k").alias("s"), F.min("k").alias("first"),
    ).withColumns({
        "model": F.concat(F.lit("m"), "part"), "case_id": F.col("supplier").cast("string"),
        "visibility": F.get(arms, F.col("arm")),
    })
    s = F.col("s")
    return runs.select(
        F.xxhash64("model", "case_id", "repetition", "visibility").alias("cell_index"),
        "model", "case_id", "repetition", "visibility",
        F.struct(
            F.when(s % 23 == 0, "crash").alias("error"),
            F.struct(
                F.when(s % 10 > 0, "component").otherwise("dependency_edge").alias("causal_scope"),
                F.when(s % 9 > 0, F.concat(F.lit("svc"), "case_id")).otherwise("other").alias("causal_component"),
                F.when(s % 7 > 0, "net").otherwise("cpu").alias("fault_category"),
                F.when(s % 8 > 0, "m1").otherwise("m2").alias("mechanism_code"),
                F.array(F.struct(
                    F.concat(F.lit("q"), F.col("first"), F.lit("-0")).alias("query_id"), F.lit("slow").alias("claim"),
                    F.array(F.lit("causal_locus")).alias("claim_types"),
                )).alias("evidence"),
            ).alias("diagnosis"),
            F.col("calls").alias("tool_calls"),
        ).alias("run"),
    )


@query(
    "a18_records_to_holm",
    "",
    f"""WITH g AS (SELECT 'm' || (l_partkey % 4) AS model, l_suppkey AS case_id, l_linenumber AS repetition,
            CASE l_returnflag WHEN 'A' THEN 'split' WHEN 'N' THEN 'raw' ELSE 'graph' END AS treatment,
            count(*) AS tool_calls, sum(l_quantity::BIGINT)::BIGINT AS rows_returned, sum(l_orderkey) AS s,
            min(l_orderkey) AS f FROM lineitem GROUP BY ALL),
          runs AS (SELECT *, NULL::BIGINT AS input_tokens, 0 AS output_tokens,
            s % 10 > 0 AND s % 9 > 0 AND s % 7 > 0 AND s % 8 > 0 AND s % 23 > 0
              AND f % 13 > 0 AND f % 11 > 0 AND f % 9 > 0 AND f % 8 > 0 AS eligible FROM g),
          {PAIRS}, {EFFECTS}, {SUMMARY}, {HOLM}
        SELECT te.model, te.metric, round(p, 9) AS sign_test_p, round(h, 9) AS holm_adjusted_p
        FROM te LEFT JOIN hm ON hm.model = te.model AND hm.metric = te.metric
        WHERE te.metric IN ('rows_returned', 'tool_calls')""",
)
def records_to_holm(t):
    """The chain from nested records over citations, flags and pairs to adjusted values."""
    path = work_dir(t.spark, "records")
    # Calls repeat their names: the text is eleven times its bytes in gzip.
    gzip = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    with settings(t.spark, SHUFFLES_GO):
        lineitem_records(t).write.options(**gzip).json(path)
    none = F.lit(None).cast("string")
    cases = t.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("case_id"), F.lit("component").alias("true_scope"),
        F.concat(F.lit("svc"), "s_suppkey").alias("true_component"), none.alias("true_edge_source"),
        none.alias("true_edge_destination"), F.lit("net").alias("true_fault_category"),
        F.array(F.lit("m1")).alias("accepted_mechanisms"),
        F.array().cast("array<string>").alias("allowed_operations"),
        F.array().cast("array<string>").alias("identities"),
    )
    with settings(t.spark, SHUFFLES_GO | DEALT_ONCE):
        runs = cut_lineage(evaluated_runs(case_files.read_runs(t.spark, path), cases, 10**6), "evaluated")
    metrics = ["rows_returned", "tool_calls"]
    paired = P.arm_pairs(runs, KEYS, "treatment", "split", "raw", [*metrics, "eligible"])
    found = P.pair_deltas(paired, KEYS, metrics, "eligible", "split", "raw")
    tested = P.case_effects(found, ["model", "case_id"], metrics)
    summed = P.effect_summary(tested.where(F.col("metric").isin(*metrics)), ["model"])
    adjusted = P.holm(cut_lineage(summed, "endpoints"), ["metric"], "sign_test_p", 6)
    return adjusted.select(
        "model", "metric", F.round("sign_test_p", 9).alias("sign_test_p"),
        F.round("holm_adjusted_p", 9).alias("holm_adjusted_p"),
    )


@query(
    "f58_report_job",
    "runs",
    """, m AS (SELECT model, CASE WHEN count(cost) = count(*) THEN sum(cost) END AS cost, min(currency) AS currency,
                bool_or(cost IS NOT NULL) AS some FROM runs GROUP BY model)
        SELECT model, CASE WHEN cost IS NOT NULL THEN 'available' ELSE 'not_estimable' END AS status,
          round(cost, 4) AS estimated_cost, currency, CASE WHEN cost IS NULL THEN 'usage_not_priceable' END AS reason_code FROM m""",
)
def report_job(t):
    """Cost status per model, as the report job derives it from priced runs."""
    runs = t.runs.withColumn("cache_breakdown_complete", F.lit(True))
    status, _ = usage_tables(runs, usd_rates(t))["cost_status"]
    return status.withColumn("estimated_cost", F.round("estimated_cost", 4))
