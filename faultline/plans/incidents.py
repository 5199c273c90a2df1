"""Incident evidence and case selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.jobs.selection import select_cases
from faultline.operators import callgraph as G
from faultline.operators import evidence as E
from faultline.operators import selection as S
from faultline.plans.registry import query
from faultline.plans.views import BOUNDARY, EVENTS_BOUNDARY, EVENTS_END, EVENTS_START, SECOND, WINDOW

BASELINE, INCIDENT = (EVENTS_START, EVENTS_BOUNDARY), (EVENTS_BOUNDARY, EVENTS_END)
PHASES = """ph AS (
 SELECT container, phase, count(v) AS sample_count, avg(v) AS mean_value, max(v) AS max_value
 FROM (SELECT c.container, p.phase, CASE WHEN
         (p.phase = 'baseline' AND ts_s >= 1704067200 AND ts_s < 1705276800)
         OR (p.phase = 'incident' AND ts_s >= 1705276800 AND ts_s < 1706659200) THEN value END AS v
       FROM points c, (VALUES ('baseline'), ('incident')) p(phase))
 GROUP BY container, phase)"""


def phases(t):
    return E.phase_aggregates(t.points, "container", "ts_s", "value", BASELINE, INCIDENT)


@query(
    "f20_phase_aggregates",
    "points",
    f""", {PHASES} SELECT container, phase, sample_count, round(mean_value, 6) AS mean_value,
          max_value FROM ph""",
)
def phase_aggregates(t):
    return phases(t).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "f21_ratio_predicate",
    "points",
    f""", {PHASES}, w AS (SELECT container,
            max(CASE WHEN phase = 'baseline' THEN max_value END) AS b,
            max(CASE WHEN phase = 'incident' THEN max_value END) AS i,
            min(sample_count) AS n FROM ph GROUP BY container)
        SELECT container, b AS baseline_value, i AS incident_value,
               coalesce(n > 0 AND i >= 1.1 * b, false) AS predicate_match FROM w""",
)
def ratio(t):
    return E.ratio_predicate(phases(t), "container", "max_value", 1.1)


@query(
    "f22_same_phases",
    "points",
    """SELECT container, count(CASE WHEN k = 7 THEN 1 END) = 0 AS canonical_result_match
       FROM points GROUP BY container""",
)
def same(t):
    value = F.when(F.col("k") == 7, F.col("value") + 0.5).otherwise(F.col("value"))
    moved = t.points.withColumn("value", value)
    other = E.phase_aggregates(
        moved, "container", "ts_s", "value", BASELINE, INCIDENT
    )
    return E.same_phases(phases(t), other, "container")


PERIOD_SQL = """CASE WHEN ts_s >= 1704067200 AND ts_s < 1705276800 THEN 'normal'
 WHEN ts_s >= 1705276800 AND ts_s < 1706659200 THEN 'abnormal' END"""
FACTS = f"""f AS (SELECT metric, container,
  count(CASE WHEN p = 'normal' THEN 1 END) AS normal_count,
  min(CASE WHEN p = 'normal' THEN value END) AS normal_min,
  max(CASE WHEN p = 'normal' THEN value END) AS normal_max,
  count(CASE WHEN p = 'normal' AND value >= 200 THEN 1 END) AS normal_high_count,
  count(CASE WHEN p = 'abnormal' THEN 1 END) AS abnormal_count,
  min(CASE WHEN p = 'abnormal' THEN value END) AS abnormal_min,
  max(CASE WHEN p = 'abnormal' THEN value END) AS abnormal_max,
  count(CASE WHEN p = 'abnormal' AND value >= 200 THEN 1 END) AS abnormal_high_count
 FROM (SELECT *, {PERIOD_SQL} AS p FROM points) WHERE p IS NOT NULL GROUP BY metric, container)"""
PROVEN = """normal_count >= 1 AND abnormal_count >= 2 AND normal_high_count = 0
 AND abnormal_high_count >= 2"""


def event_period():
    return W.period_of("ts_s", *BASELINE, EVENTS_END)


def facts(t):
    return E.threshold_facts(
        t.points, ["metric", "container"], event_period(), "value", 200.0, empty_as_zero=False
    )


@query(
    "f23_threshold_facts",
    "points",
    f""", {FACTS}
        SELECT metric, container, 'normal' AS period, normal_count AS sample_count,
               normal_min AS min_value, normal_max AS max_value, normal_high_count AS high_count FROM f
        UNION ALL SELECT metric, container, 'abnormal', abnormal_count, abnormal_min, abnormal_max,
               abnormal_high_count FROM f""",
)
def threshold_facts(t):
    return E.facts_by_period(facts(t), ["metric", "container"])


@query(
    "f24_transition_proven",
    "points",
    f", {FACTS} SELECT metric, container, {PROVEN} AS proven FROM f",
)
def proven(t):
    return facts(t).select("metric", "container", E.transition_proven().alias("proven"))


@query(
    "f25_call_path_delay",
    "clients_src servers_src spans",
    """, tagged AS (SELECT *, CASE
           WHEN ts_ns >= 560000 * 1000000000::BIGINT AND ts_ns < 620017 * 1000000000::BIGINT THEN 'normal'
           WHEN ts_ns >= 620017 * 1000000000::BIGINT AND ts_ns < 680000 * 1000000000::BIGINT THEN 'abnormal'
           END AS period FROM spans),
       gaps AS (SELECT c.service_name AS src_id, s.service_name AS dst_id, c.period,
              min(s.ts_ns) - c.ts_ns AS gap
       FROM tagged c JOIN tagged s ON c.trace_id = s.trace_id AND s.parent_span_id = c.span_id
        AND c.period = s.period
       WHERE c.span_kind = 'SPAN_KIND_CLIENT' AND s.span_kind = 'SPAN_KIND_SERVER'
       GROUP BY c.trace_id, c.span_id, c.period, c.service_name, s.service_name, c.ts_ns
       HAVING count(*) = 1)
       SELECT src_id, dst_id, count(CASE WHEN period = 'normal' THEN 1 END) AS normal_count,
         count(CASE WHEN period = 'abnormal' THEN 1 END) AS abnormal_count,
         coalesce(min(CASE WHEN period = 'normal' THEN gap END), 0) AS normal_min,
         coalesce(max(CASE WHEN period = 'normal' THEN gap END), 0) AS normal_max,
         coalesce(min(CASE WHEN period = 'abnormal' THEN gap END), 0) AS abnormal_min,
         coalesce(max(CASE WHEN period = 'abnormal' THEN gap END), 0) AS abnormal_max,
         count(CASE WHEN period = 'normal' AND gap >= 500000000 THEN 1 END) AS normal_high_count,
         count(CASE WHEN period = 'abnormal' AND gap >= 500000000 THEN 1 END) AS abnormal_high_count
       FROM gaps GROUP BY src_id, dst_id""",
)
def delay(t):
    period = W.period_of("ts_ns", WINDOW[0] * SECOND, BOUNDARY * SECOND, WINDOW[1] * SECOND)
    gaps = G.sole_server_gaps(t.spans, period)
    return E.delay_facts(gaps)


@query(
    "f26_peer_maximum",
    "node_telemetry node_cases",
    """SELECT c.case_id, coalesce(max(t.value), 0.0) AS peer_abnormal_max FROM node_cases c
       LEFT JOIN node_telemetry t ON t.case_id = c.case_id AND t.metric = c.metric
        AND t.node <> c.node AND t.ts >= c.alert AND t.ts < c.window_end GROUP BY c.case_id""",
)
def peers(t):
    return E.peer_maximum(t.node_telemetry, t.node_cases)


PROFILES = """prof AS (SELECT c.case_id, c.node,
  coalesce(max(CASE WHEN t.node = c.node AND t.ts >= 2 * c.alert - c.window_end AND t.ts < c.alert
               THEN value END), 0.0) AS normal_max,
  coalesce(max(CASE WHEN t.node = c.node AND t.ts >= c.alert AND t.ts < c.window_end
               THEN value END), 0.0) AS abnormal_max,
  coalesce(max(CASE WHEN t.node <> c.node AND t.ts >= c.alert AND t.ts < c.window_end
               THEN value END), 0.0) AS peer_abnormal_max,
  count(CASE WHEN t.node = c.node AND t.ts >= 2 * c.alert - c.window_end AND t.ts < c.alert
        THEN 1 END) AS nc,
  count(CASE WHEN t.node = c.node AND t.ts >= 2 * c.alert - c.window_end AND t.ts < c.alert
        AND value >= threshold THEN 1 END) AS nh,
  count(CASE WHEN t.node = c.node AND t.ts >= c.alert AND t.ts < c.window_end
        AND value >= threshold THEN 1 END) AS ah
 FROM node_cases c LEFT JOIN node_telemetry t ON t.case_id = c.case_id AND t.metric = c.metric
 GROUP BY c.case_id, c.node)"""


@query(
    "f27_candidate_profiles",
    "node_telemetry node_cases",
    f""", {PROFILES} SELECT case_id, node, normal_max, abnormal_max, peer_abnormal_max,
            nc >= 1 AND nh = 0 AND ah >= 2 AS oracle_available FROM prof""",
)
def profiles(t):
    return E.candidate_profiles(t.node_telemetry, t.node_cases)


IDENTITY = ["container", "pod", "deployment", "service_name"]


@query(
    "f28_identity_domains",
    "points",
    " UNION ALL ".join(
        f"SELECT DISTINCT metric, '{c}' AS \"column\", {c} AS value FROM points" for c in IDENTITY
    ),
)
def domains(t):
    return E.identity_domains(t.points, "metric", IDENTITY)


@query(
    "f29_scope_predicates",
    "points",
    """SELECT metric, deployment, CASE WHEN min(s) = max(s) THEN min(s) END AS scope_value
       FROM (SELECT metric, deployment, CASE WHEN k = 3 THEN 'other' ELSE namespace END AS s
             FROM points WHERE k % 7 <> 0) GROUP BY metric, deployment""",
)
def scopes(t):
    scope = (
        F.when(F.col("k") % 7 == 0, "").when(F.col("k") == 3, "other").otherwise(F.col("namespace"))
    )
    return E.scope_predicates(t.points.withColumn("scope", scope), "metric", "deployment", "scope")


@query(
    "e16_equivalent_identities",
    "points",
    """, w AS (SELECT metric, container, pod AS pod, deployment,
                 CASE WHEN k = 5 THEN '' ELSE 'i' || container END AS image FROM points),
       l AS (SELECT metric, container, 'pod' AS col, pod AS value FROM w
             UNION ALL SELECT metric, container, 'deployment', deployment FROM w
             UNION ALL SELECT metric, container, 'image', image FROM w),
       f AS (SELECT metric, container, col, count(*) AS n, min(nullif(value, '')) AS value
             FROM l GROUP BY ALL HAVING count(DISTINCT nullif(value, '')) = 1),
       r AS (SELECT metric, col, value, count(*) AS n, min(container) AS container
             FROM l GROUP BY metric, col, value HAVING count(DISTINCT container) = 1)
       SELECT f.metric, f.container, f.col AS "column", f.value FROM f
       JOIN r ON f.metric = r.metric AND f.col = r.col AND f.value = r.value
        AND f.container = r.container AND f.n = r.n""",
)
def equivalents(t):
    image = F.when(F.col("k") == 5, "").otherwise(F.concat(F.lit("i"), "container"))
    return E.equivalent_identities(
        t.points.withColumn("image", image), "metric", "container", ["pod", "deployment", "image"]
    )


@query(
    "e18_pattern_bindings",
    "",
    """WITH p AS (SELECT c_custkey AS pattern_id, c_custkey % 4 = 2 AS ignore_case,
           'NATION_' || c_nationkey AS target, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey
             WHEN 1 THEN '%_' || c_nationkey WHEN 2 THEN 'nation_' || c_nationkey || '%' ELSE '%' END
             AS pattern FROM customer)
       SELECT pattern_id, count(n_name) AS matches,
         count(n_name) = 1 AND max(n_name) = min(target) AS binds
       FROM p LEFT JOIN nation ON CASE WHEN ignore_case THEN n_name ILIKE pattern
         ELSE n_name LIKE pattern END
       GROUP BY pattern_id""",
)
def bindings(t):
    k = F.col("c_custkey") % 4
    name = F.concat(F.lit("NATION_"), "c_nationkey")
    pattern = (
        F.when(k == 0, name)
        .when(k == 1, F.concat(F.lit("%_"), "c_nationkey"))
        .when(k == 2, F.concat(F.lit("nation_"), "c_nationkey", F.lit("%")))
        .otherwise("%")
    )
    patterns = t.table("customer").select(
        F.col("c_custkey").alias("pattern_id"), F.lit("nation").alias("column"),
        pattern.alias("pattern"), (k == 2).alias("ignore_case"), name.alias("target"),
    )
    values = t.table("nation").select(F.lit("nation").alias("column"), F.col("n_name").alias("value"))
    return E.pattern_bindings(patterns, values.distinct())


@query(
    "f30_alternative_signals",
    "points",
    f""", {FACTS} SELECT container, metric, normal_count, normal_max, abnormal_count, abnormal_max,
          abnormal_high_count FROM f WHERE metric IN ('view', 'click', 'purchase') AND {PROVEN}""",
)
def alternatives(t):
    return E.alternative_signals(
        t.points, "container", ["view", "click", "purchase"], event_period(), 200.0
    ).select(
        "container", "metric", "normal_count", "normal_max", "abnormal_count", "abnormal_max",
        "abnormal_high_count",
    )


def failure_events(t):
    """Events as JSON log lines, some of them not JSON at all."""
    k = F.col("k")
    normal = F.col("ts_s") < EVENTS_BOUNDARY
    quiet = normal & (F.col("user_id") % 4 == 0)
    body = F.to_json(
        F.struct(
            F.struct(
                F.when(F.col("metric") == "error", "Failed").otherwise("Started").alias("reason"),
                F.when(
                    (k % 3 == 0) & ~quiet, 'exec: "run": executable file not found in $PATH: unknown'
                )
                .otherwise("Back-off")
                .alias("note"),
                F.struct(
                    F.concat(F.lit("spec.containers{"), "container", F.lit("}")).alias("fieldPath")
                ).alias("regarding"),
            ).alias("object")
        )
    )
    return t.points.select(
        "ts_s", "service_name", F.when(k % 17 == 0, "plain text").otherwise(body).alias("message")
    )


@query(
    "f31_direct_log_evidence",
    "points",
    """SELECT container, count(CASE WHEN p = 'normal' THEN 1 END) AS normal_count,
         count(CASE WHEN p = 'abnormal' THEN 1 END) AS abnormal_count,
         count(CASE WHEN p = 'normal' THEN 1 END) = 0
           AND count(CASE WHEN p = 'abnormal' THEN 1 END) >= 1 AS proven
       FROM (SELECT *, CASE WHEN ts_s < 1705276800 THEN 'normal' ELSE 'abnormal' END AS p FROM points)
       WHERE metric = 'error' AND k % 3 = 0 AND k % 17 <> 0
         AND NOT (p = 'normal' AND user_id % 4 = 0) GROUP BY container""",
)
def direct_logs(t):
    period = W.period_by_boundary("ts_s", EVENTS_BOUNDARY)
    return E.direct_log_evidence(failure_events(t), period, [])


HITS = """CASE WHEN n <= 0 OR hi < mean THEN NULL WHEN hi < threshold THEN 0
 WHEN hi = threshold THEN CASE WHEN mean = threshold THEN n ELSE 1 END
 WHEN mean <= threshold THEN 1
 ELSE least(n, greatest(1, floor(n * (mean - threshold) / (hi - threshold))::BIGINT + 1)) END"""


@query(
    "f33_minimum_hits",
    "",
    f"""WITH a AS (SELECT l_suppkey AS case_id, l_returnflag AS flag, count(*) AS n,
            sum(l_quantity) / count(*) AS mean, max(l_quantity) AS hi,
            (20 + l_suppkey % 31)::DOUBLE AS threshold FROM lineitem GROUP BY l_suppkey, l_returnflag)
        SELECT case_id, flag, ({HITS})::BIGINT AS hits FROM a""",
)
def hits(t):
    grouped = t.table("lineitem").groupBy(
        F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("flag")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"),
        F.max("l_quantity").alias("hi"),
    )
    mean = F.col("total") / F.col("n")
    threshold = (F.lit(20) + F.col("case_id") % 31).cast("double")
    return grouped.select("case_id", "flag", E.minimum_hits("n", mean, "hi", threshold).alias("hits"))


@query(
    "f34_period_facts",
    "submitted",
    f""", s AS (SELECT case_id, period, n, lo * scale AS lo, hi * scale AS hi, mean * scale AS mean,
             threshold FROM submitted),
        j AS (SELECT *, CASE WHEN lo >= threshold THEN n WHEN hi < threshold THEN 0
                WHEN mean IS NOT NULL AND hi IS NOT NULL THEN {HITS} WHEN hi >= threshold THEN 1 END
                AS high, period IS NOT NULL AND (n <= 0 OR coalesce(lo > hi, false)
                OR coalesce(mean < lo, false) OR coalesce(mean > hi, false)) AS bad FROM s),
        g AS (SELECT case_id, bool_or(bad) AS rejected, bool_or(period IS NULL) AS hole,
          coalesce(sum(CASE WHEN period = 'normal' THEN n END), 0)::BIGINT AS nc,
          coalesce(sum(CASE WHEN period = 'normal' THEN coalesce(high, 0) END), 0)::BIGINT AS nh,
          coalesce(bool_and(CASE WHEN period = 'normal' THEN high IS NOT NULL END), false) AS nv,
          coalesce(sum(CASE WHEN period = 'abnormal' THEN n END), 0)::BIGINT AS ac,
          coalesce(sum(CASE WHEN period = 'abnormal' THEN coalesce(high, 0) END), 0)::BIGINT AS ah,
          coalesce(bool_and(CASE WHEN period = 'abnormal' THEN high IS NOT NULL END), false) AS av
          FROM j GROUP BY case_id)
        SELECT case_id, rejected, CASE WHEN NOT rejected THEN nc END AS normal_count,
          CASE WHEN NOT rejected THEN nh END AS normal_high_count,
          CASE WHEN NOT rejected THEN ac END AS abnormal_count,
          CASE WHEN NOT rejected THEN ah END AS abnormal_high_count,
          CASE WHEN NOT rejected THEN nv AND NOT hole END AS normal_proven,
          CASE WHEN NOT rejected THEN av END AS abnormal_proven FROM g""",
)
def period_facts(t):
    return E.period_facts(t.submitted, "case_id")


@query(
    "f35_timestamp_floors",
    "points",
    """SELECT user_id, metric, CASE WHEN max(ts_s) > min(ts_s) THEN 2 ELSE 1 END::BIGINT AS row_floor
       FROM points GROUP BY user_id, metric""",
)
def floors(t):
    seen = t.points.groupBy("user_id", "metric").agg(
        F.min("ts_s").alias("first"), F.max("ts_s").alias("last")
    )
    return seen.select("user_id", "metric", E.timestamp_floor("first", "last").alias("row_floor"))


@query(
    "f40_claim_verdicts",
    "submitted",
    """SELECT case_id, part, CASE WHEN array_length(b) = 0 THEN '' ELSE array_to_string(b, ',') END AS baseline_codes,
         CASE WHEN array_length(a) = 0 THEN '' ELSE array_to_string(a, ',') END AS anomaly_codes,
         array_length(b) = 0 AS baseline_clear, array_length(a) = 0 AS anomaly_present
       FROM (SELECT case_id, part,
           list_filter([CASE WHEN part = 7 THEN 'period_not_covered'
                  WHEN part = 6 THEN 'time_coverage_incomplete' END,
             CASE WHEN part = 5 THEN 'value_filtered_for_universal_claim' END,
             CASE WHEN part = 4 THEN 'result_incomplete' END,
             CASE WHEN part = 3 OR case_id % 9 = 0 THEN 'lineage_unproven'
                  WHEN n - 3 < 1 THEN 'baseline_observations_missing'
                  WHEN case_id % 4 > 0 THEN 'baseline_threshold_violation' END], lambda x: x IS NOT NULL) AS b,
           list_filter([CASE WHEN case_id % 9 = 0 THEN 'lineage_unproven'
                  WHEN part < 2 THEN 'insufficient_anomalous_observations' END], lambda x: x IS NOT NULL) AS a
         FROM submitted)""",
)
def verdicts(t):
    part, case = F.col("part"), F.col("case_id")
    both = F.array(F.lit("normal"), F.lit("abnormal"))
    late = F.array(F.lit("abnormal"))
    measured = case % 9 != 0
    scopes_ = t.submitted.select(
        "case_id", "part",
        F.when(part == 7, late).otherwise(both).alias("periods"),
        F.when(part >= 6, late).otherwise(both).alias("complete_periods"),
        F.when(part == 3, late).otherwise(both).alias("proven_periods"),
        (part != 5).alias("value_independent"), (part != 4).alias("result_complete"),
        F.when(measured, F.col("n") - 3).alias("normal_count"),
        F.when(measured, case % 4).alias("normal_high_count"),
        F.when(measured, part).alias("abnormal_high_count"),
    )
    return E.claim_verdicts(scopes_).select(
        "case_id", "part",
        F.array_join("baseline_rejection_codes", ",").alias("baseline_codes"),
        F.array_join("anomaly_rejection_codes", ",").alias("anomaly_codes"),
        "baseline_clear", "anomaly_present",
    )


EXTREMES = """x AS (SELECT case_id, CASE WHEN part <= 3 THEN hi * 1024 END AS normal_max,
  CASE WHEN part > 3 AND case_id % 6 <> 0 THEN lo * 1024 END AS abnormal_min,
  CASE WHEN part > 3 THEN hi * 1024 END AS abnormal_max,
  (CASE WHEN case_id % 2 = 0 THEN 1 ELSE 12.5 END)::DOUBLE AS threshold,
  case_id % 3 = 1 AS restart FROM submitted)"""


@query(
    "f95_conditional_floors",
    "submitted",
    f""", {EXTREMES},
       g AS (SELECT *, CASE WHEN abnormal_max IS NULL THEN 0
           WHEN abnormal_min >= threshold THEN CASE WHEN abnormal_min <> abnormal_max THEN 2 ELSE 1 END
           WHEN abnormal_max >= threshold THEN CASE WHEN restart THEN floor(abnormal_max / threshold)
             ELSE 1 END ELSE 0 END::BIGINT AS fl FROM x)
       SELECT case_id, count(normal_max) AS normal_count,
         count(CASE WHEN normal_max >= threshold THEN 1 END) AS normal_high_count,
         sum(fl)::BIGINT AS abnormal_count, sum(fl)::BIGINT AS abnormal_high_count,
         count(normal_max) > 0 AS normal_proven, sum(fl) > 0 AS abnormal_proven
       FROM g GROUP BY case_id""",
)
def conditional(t):
    part, case = F.col("part"), F.col("case_id")
    rows = t.submitted.select(
        "case_id",
        F.when(part <= 3, F.col("hi") * 1024).alias("normal_max"),
        F.when((part > 3) & (case % 6 != 0), F.col("lo") * 1024).alias("abnormal_min"),
        F.when(part > 3, F.col("hi") * 1024).alias("abnormal_max"),
        F.when(case % 2 == 0, 1.0).otherwise(12.5).alias("threshold"),
        (case % 3 == 1).alias("restart"),
    )
    return E.conditional_floors(rows, "case_id", "restart")


@query(
    "f96_unit_normalization",
    "submitted",
    """SELECT case_id, part, lo * scale AS lowest, hi * scale AS highest,
         coalesce(l2 > hi, false) OR coalesce(mean < l2, false) OR coalesce(mean > hi, false)
           AS inconsistent
       FROM (SELECT *, CASE WHEN part = 2 THEN hi + 1 ELSE lo END AS l2 FROM submitted)""",
)
def units(t):
    lo = F.when(F.col("part") == 2, F.col("hi") + 1).otherwise(F.col("lo"))
    return t.submitted.select(
        "case_id", "part",
        E.in_canonical_unit("lo", "scale").alias("lowest"),
        E.in_canonical_unit("hi", "scale").alias("highest"),
        E.inconsistent_summary(lo, "mean", "hi").alias("inconsistent"),
    )


@query(
    "c10_boundary_split",
    "clients_src",
    """, c AS (SELECT n_name AS case_id, (560040 + n_nationkey * 3000
             + CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey * 2 END)::BIGINT AS b FROM nation),
       m AS (SELECT *, (b // 60) * 60 AS minute FROM c),
       g AS (SELECT case_id, b, minute,
           count(CASE WHEN ts_ns // 1000000000 < b THEN 1 END) AS nc,
           count(CASE WHEN ts_ns // 1000000000 >= b THEN 1 END) AS ac
         FROM m LEFT JOIN clients_src s ON (s.ts_ns // 60000000000) * 60 = m.minute
         GROUP BY case_id, b, minute)
       SELECT case_id, minute AS boundary_minute, nc AS normal_clients, ac AS abnormal_clients,
         b = minute OR nc = 0 OR ac = 0 AS split_supported,
         CASE WHEN b = minute THEN b WHEN nc = 0 OR ac = 0 THEN
           CASE WHEN nc > 0 THEN minute + 60 ELSE minute END END AS split FROM g""",
)
def split(t):
    n = F.col("n_nationkey")
    boundary = F.lit(560040) + n * 3000 + F.when(n % 3 == 0, 0).otherwise(n * 2)
    cases = t.table("nation").select(
        F.col("n_name").alias("case_id"), boundary.cast("bigint").alias("boundary")
    )
    return E.boundary_split(t.spans, cases)


@query(
    "c13_case_admission",
    "",
    """SELECT o_orderkey AS case_id, o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0
           AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0
           AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS admitted,
         (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
          + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END
          + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END
          + CASE WHEN o_orderkey % 17 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0 AND false)
              THEN 1 ELSE 0 END)::BIGINT AS failed_rules
       FROM orders""",
)
def admissions(t):
    k = F.col("o_orderkey")
    service = F.concat(F.lit("svc"), F.col("o_custkey") % 5)
    directed = F.col("o_custkey") % 2 == 0
    roots = F.when(k % 7 == 0, F.array(service, F.lit("extra"))).otherwise(F.array(service))
    wrong = F.array(F.lit("wrong"))
    truth = F.when(k % 11 == 0, wrong).when(
        directed, F.array(F.lit("db"), service, F.lit(""))
    ).otherwise(F.array(service))
    cases = t.table("orders").select(
        k.alias("case_id"), (k % 2 == 0).alias("hybrid"), F.lit("PodFailure").alias("manifest_kind"),
        F.when(k % 3 == 0, "inject_failed").otherwise("inject_success").alias("state"),
        F.when(k % 5 == 0, "CPUStress").otherwise("PodFailure").alias("injection_kind"),
        roots.alias("roots"), truth.alias("truth_services"),
        F.when(directed, service).alias("endpoint_source"),
        F.when(directed, "db").alias("endpoint_destination"),
        k.alias("normal_start"), (k + 10).alias("normal_end"),
        (k + F.when(k % 13 == 0, 11).otherwise(10)).alias("abnormal_start"),
        (k + 30).alias("abnormal_end"),
        (k + F.when(k % 17 == 0, 5).otherwise(F.when(k % 13 == 0, 11).otherwise(10))).alias(
            "injection_time"
        ),
    )
    return S.admissions(cases).select(
        "case_id", "admitted", F.size("rejections").cast("bigint").alias("failed_rules")
    )


@query(
    "g1_mechanism_rank",
    "",
    """SELECT c_mktsegment, c_name, row_number() OVER (PARTITION BY c_mktsegment
         ORDER BY sha256('seed-1:' || c_mktsegment || ':' || c_name), c_name) AS rank FROM customer""",
)
def mechanism_rank(t):
    rows = t.table("customer").select("c_mktsegment", "c_name")
    return S.mechanism_rank(rows, "c_mktsegment", "c_name", "seed-1")


@query(
    "g2_seeded_rank",
    "",
    """SELECT c, row_number() OVER (ORDER BY sha256('seed-2' || chr(0) || c)) AS rank
       FROM (SELECT DISTINCT 'case-' || o_custkey AS c FROM orders)""",
)
def seeded(t):
    rows = t.table("orders").select(F.concat(F.lit("case-"), "o_custkey").alias("c"))
    return S.seeded_rank(rows, "c", "seed-2")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
QUOTAS = {
    (segment, f"s{system}"): 2 + at + system
    for at, segment in enumerate(SEGMENTS)
    for system in (0, 1)
}
STRATUM = ["c_mktsegment", "system"]
QUOTA_SQL = ", ".join(f"('{m}', '{s}', {n})" for (m, s), n in QUOTAS.items())


def quota_candidates(t):
    rows = t.table("customer").select(
        "c_mktsegment", F.concat(F.lit("s"), F.col("c_nationkey") % 2).alias("system"), "c_name",
        (F.col("c_acctbal") > 0).alias("passed"),
    )
    return S.mechanism_rank(rows, "c_mktsegment", "c_name", "seed-1")


@query(
    "g4_quota_selection",
    "",
    f"""WITH r AS (SELECT c_mktsegment, 's' || (c_nationkey % 2) AS system, c_name,
            c_acctbal > 0 AS passed, sha256('seed-1:' || c_mktsegment || ':' || c_name) AS h
          FROM customer),
        p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, system ORDER BY h) AS position
              FROM r WHERE passed)
        SELECT p.c_mktsegment, p.system, c_name, position FROM p
        JOIN (VALUES {QUOTA_SQL}) q(m, s, n) ON m = c_mktsegment AND s = system
        WHERE position <= n""",
)
def quota(t):
    return S.quota_selection(quota_candidates(t), QUOTAS, STRATUM, "rank", "passed").select(
        *STRATUM, "c_name", "position"
    )


# Quotas for every stratum of all customers; the larger half cannot be met.
WANTED = {key: n if at % 2 else 10**7 for at, (key, n) in enumerate(QUOTAS.items())}
WANTED_SQL = ", ".join(f"('{m}', '{s}', {n})" for (m, s), n in WANTED.items())


@query(
    "g4_quota_shortfalls",
    "",
    f"""WITH c AS (SELECT c_mktsegment, 's' || (c_nationkey % 2) AS system, count(*) AS n
          FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
        SELECT m AS c_mktsegment, s AS system, q.n AS quota, coalesce(c.n, 0)::BIGINT AS selected
        FROM (VALUES {WANTED_SQL}) q(m, s, n) LEFT JOIN c ON m = c_mktsegment AND s = system
        WHERE coalesce(c.n, 0) < q.n""",
)
def shortfalls(t):
    chosen = S.quota_selection(quota_candidates(t), WANTED, STRATUM, "rank", "passed")
    return S.quota_shortfalls(chosen, WANTED, STRATUM)


@query(
    "g5_typical_cases",
    "",
    """WITH p AS (SELECT o_orderpriority AS kind, o_orderkey AS case_id,
           CASE WHEN o_custkey % 10 > 0 THEN o_totalprice / 2 END AS a, o_totalprice AS b,
           o_custkey::DOUBLE AS c FROM orders),
       m AS (SELECT kind, median(a) AS ma, median(b) AS mb, median(c) AS mc FROM p
             WHERE a IS NOT NULL GROUP BY kind),
       d AS (SELECT p.kind, case_id, abs(a - ma) + abs(b - mb) + abs(c - mc) AS d
             FROM p JOIN m ON p.kind = m.kind WHERE a IS NOT NULL)
       SELECT kind, case_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY d, case_id)
         AS rn FROM d) WHERE rn = 1""",
)
def typical(t):
    rows = t.table("orders").select(
        F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_custkey") % 10 > 0, F.col("o_totalprice") / 2).alias("normal_max"),
        F.col("o_totalprice").alias("abnormal_max"),
        F.col("o_custkey").cast("double").alias("peer_abnormal_max"),
    )
    return S.typical_cases(rows, "kind", "case_id")


@query(
    "g6_score_ranking",
    "",
    """SELECT c_name, score, row_number() OVER (ORDER BY score DESC, c_name) AS rank
       FROM (SELECT c_name, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal / 1000, 1) + 0 END AS score
             FROM customer) WHERE score IS NOT NULL""",
)
def ranking(t):
    score = F.when(F.col("c_custkey") % 9 > 0, F.round(F.col("c_acctbal") / 1000, 1))
    return S.score_ranking(t.table("customer").select("c_name", score.alias("score")), "c_name", "score")


def manifest(t):
    k = F.col("c_custkey")
    service = F.array(F.col("c_mktsegment"))
    return t.table("customer").select(
        F.col("c_name").alias("name"),
        F.when(k % 4 == 0, "PodFailure").when(k % 4 == 1, "CPUStress").otherwise("Unknown").alias(
            "primary_kind"
        ),
        F.concat(F.lit("sys"), F.col("c_nationkey") % 3).alias("system"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 7 == 0).alias("hybrid"),
        F.when(k % 11 == 0, F.concat(service, service)).otherwise(service).alias("root_services"),
    )


def exclusions(t):
    """Every tenth customer with an order is excluded; one name in a hundred is unknown."""
    k = F.col("o_custkey")
    name = F.format_string("Customer#%09d", k)
    return (
        t.table("orders").where(k % 10 == 0)
        .select(F.when(k % 100 == 0, F.concat(F.lit("x"), name)).otherwise(name).alias("name"))
        .distinct()
    )


EXCLUDED = """x AS (SELECT DISTINCT CASE WHEN o_custkey % 100 = 0 THEN 'x' ELSE '' END
  || printf('Customer#%09d', o_custkey) AS name FROM orders WHERE o_custkey % 10 = 0)"""


@query(
    "i11_unknown_exclusions",
    "",
    f"WITH {EXCLUDED} SELECT name FROM x WHERE name NOT IN (SELECT c_name FROM customer)",
)
def unknown(t):
    return S.unknown_exclusions(exclusions(t), manifest(t))


@query(
    "i12_eligible_candidates",
    "",
    f"""WITH {EXCLUDED} SELECT c_name AS name FROM customer
        WHERE c_custkey % 4 <= 1 AND c_nationkey % 3 <= 1 AND c_custkey % 5 <> 0
          AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_name NOT IN (SELECT name FROM x)""",
)
def eligible(t):
    return S.eligible_candidates(
        manifest(t), ["PodFailure", "CPUStress"], ["sys0", "sys1"], exclusions(t)
    ).select("name")


# Half of the smallest stratum of the smallest table, in every stratum.
JOB_QUOTAS = {(m, f"sys{n}"): 1 for m in ("network", "resource") for n in (0, 1)}
JOB_KINDS = {"PodFailure": "network", "CPUStress": "resource"}


@query(
    "g4_selection_job",
    "",
    f"""WITH {EXCLUDED}, c AS (SELECT c_name AS name, 'sys' || (c_nationkey % 3) AS system,
            CASE c_custkey % 4 WHEN 0 THEN 'network' ELSE 'resource' END AS mechanism, c_acctbal > 0 AS passed FROM customer
          WHERE c_custkey % 4 <= 1 AND c_nationkey % 3 <= 1 AND c_custkey % 5 <> 0
            AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_name NOT IN (SELECT name FROM x)),
        r AS (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY sha256('seed-9:' || mechanism || ':' || name)) AS rank
              FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY mechanism, system ORDER BY rank) AS position FROM r WHERE passed)
        SELECT name, mechanism, system, rank, position, row_number() OVER (ORDER BY mechanism, rank) AS number
        FROM p WHERE position <= 1""",
)
def selection_job(t):
    audits = t.table("customer").select(F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("passed"))
    known = exclusions(t).join(manifest(t).select("name"), "name", "left_semi")
    return select_cases(manifest(t), known, audits, JOB_KINDS, ["sys0", "sys1"], JOB_QUOTAS, "seed-9").select(
        "name", "mechanism", "system", "rank", "position", "number")
