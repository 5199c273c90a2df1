"""Evaluation queries over recorded investigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import windows as W
from faultline.jobs.evaluation import adjudicated_runs
from faultline.operators import evaluate as V
from faultline.plans.registry import query

RESOLVED = "calls citations folded_calls resolved"


def resolved(t):
    return V.resolve_citations(t.citations, t.calls)


@query(
    "e9_resolve_citations",
    RESOLVED,
    "SELECT run_id, ordinal, query_id, matches, resolution, execution_valid, call_ordinal FROM resolved",
)
def resolve(t):
    return resolved(t).select(
        "run_id", "ordinal", "query_id", "matches", "resolution", "execution_valid", "call_ordinal"
    )


@query(
    "f39_evidence_calls",
    "calls",
    """SELECT tool_name, operation, count(*) AS calls, count(CASE WHEN
         (CASE tool_name WHEN 'query_metrics' THEN operation IN ('query', 'query_range')
            WHEN 'query_logs' THEN operation = 'query_range' WHEN 'execute_sql' THEN len(base_tables) > 0
            WHEN 'query_semantic_graph' THEN true ELSE false END)
         AND NOT failed AND result_query_id = query_id AND NOT truncated THEN 1 END) AS evidence
       FROM calls GROUP BY tool_name, operation""",
)
def evidence_calls(t):
    return t.calls.groupBy("tool_name", "operation").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(V.evidence_call()).alias("evidence")
    )


INTEGRITY = """integ AS (SELECT run_id, count(*) AS cited, count(CASE WHEN execution_valid THEN 1 END) AS valid,
  count(DISTINCT query_id) = count(*) AS uniq,
  bool_and(len(claim_types) > 0 AND len(list_distinct(claim_types)) = len(claim_types)) AS typed
  FROM resolved GROUP BY run_id)"""


@query(
    "f38_citation_integrity",
    RESOLVED,
    f""", {INTEGRITY} SELECT run_id, cited AS cited_evidence_count, valid AS valid_evidence_count,
          uniq AS evidence_ids_unique, typed AS typed_evidence,
          uniq AND valid = cited AS citations_execution_valid FROM integ""",
)
def integrity(t):
    return V.citation_integrity(resolved(t))


def single_locus_runs(t):
    """Orders as runs and their customers as cases."""
    k = F.col("o_orderkey") % 6
    name = F.col("c_mktsegment")
    joined = t.table("orders").join(
        t.table("customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        "o_orderkey",
        F.when(k == 0, F.concat(F.lower(name), F.lit(" service")))
        .when(k == 1, name)
        .when(k == 2, "other")
        .otherwise(F.concat(name, F.lit("-pod")))
        .alias("component"),
        F.when(k < 5, F.when(F.col("o_custkey") % 3 == 0, "CPU-Stress").otherwise("Mem")).alias(
            "fault_type"
        ),
        F.when(k < 5, F.when(F.col("o_custkey") % 3 == 0, "cpu").otherwise("memory")).alias(
            "fault_category"
        ),
        (F.col("o_custkey") % 5 > 0).alias("scoped"),
        name.alias("true_component"),
        F.when(F.col("o_custkey") % 2 == 0, "cpu stress").otherwise("MEM").alias("true_fault_type"),
        F.when(F.col("o_custkey") % 2 == 0, "cpu").alias("true_category"),
        (F.col("o_custkey") % 7 > 0).alias("component_scoreable"),
        (F.col("o_orderkey") % 4).alias("cited_evidence_count"),
        (F.col("o_orderkey") % 4 - F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)).alias(
            "valid_evidence_count"
        ),
        (F.col("o_orderkey") % 11 == 0).alias("runner_error"),
        (F.col("o_orderkey") % 13 == 0).alias("tool_budget_exhausted"),
    )


@query(
    "f36_single_locus_evaluation",
    "",
    """WITH j AS (SELECT o_orderkey, o_custkey AS c, o_orderkey % 6 AS k, o_orderkey AS o FROM orders
         JOIN customer ON o_custkey = c_custkey),
       m AS (SELECT *, CASE WHEN c % 7 > 0 THEN k <> 2 AND k < 5 AND c % 5 > 0 END AS comp,
           k < 5 AND (c % 3 = 0) = (c % 2 = 0) AS kind,
           k < 5 AND (c % 3 = 0) = (c % 2 = 0) AS cat FROM j)
       SELECT o_orderkey, comp AS causal_component_match, kind AS fault_type_match,
         cat AS fault_category_match, CASE WHEN comp IS NOT NULL THEN comp AND kind END AS joint_match,
         coalesce(comp AND kind, false) AND o % 4 > 0 AND o % 9 <> 0 AND o % 11 <> 0 AND o % 13 <> 0
           AS valid_completion FROM m""",
)
def single_locus(t):
    flags = V.single_locus_matches(single_locus_runs(t))
    return flags.select(
        "o_orderkey", "causal_component_match", "fault_type_match", "fault_category_match",
        "joint_match", V.valid_completion().alias("valid_completion"),
    )


def scoped_runs(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    edge_case = c % 2 == 0
    edge_answer = k % 3 > 0
    name = F.concat(F.lit("svc"), c % 5)
    return t.table("orders").select(
        "o_orderkey",
        F.when(edge_answer, "dependency_edge").otherwise("component").alias("scope"),
        F.when(~edge_answer, F.when(k % 4 == 0, F.concat(name, F.lit("-7f"))).otherwise(name)).alias(
            "component"
        ),
        F.when(edge_answer, F.concat(name, F.lit(" service"))).alias("edge_source"),
        F.when(edge_answer, F.when(k % 5 == 0, "cache").otherwise("db")).alias("edge_destination"),
        F.when(k % 7 == 0, "cpu").otherwise("delay").alias("fault_category"),
        F.when(k % 6 == 0, "packet_loss").when(k % 6 == 1, "restart").otherwise(
            "call_path_delay"
        ).alias("mechanism"),
        F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, " GET /a ").otherwise("other").alias(
            "operation"
        ),
        F.when(edge_case, "dependency_edge").otherwise("component").alias("true_scope"),
        F.when(~edge_case, name).alias("true_component"),
        F.when(edge_case, name).alias("true_edge_source"),
        F.when(edge_case, "db").alias("true_edge_destination"),
        F.lit("delay").alias("true_fault_category"),
        F.array(F.concat(name, F.lit("-7f"))).alias("identities"),
        F.array(F.lit("call_path_delay"), F.lit("restart")).alias("accepted_mechanisms"),
        F.when(c % 3 == 0, F.array(F.lit("GET /a"), F.lit("GET /b"))).alias("allowed_operations"),
    )


@query(
    "f37_scoped_evaluation",
    "",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
       f AS (SELECT *, (c % 2 = 0) = (k % 3 > 0) AS s,
           CASE WHEN c % 2 = 0 THEN k % 3 > 0 AND k % 5 > 0 ELSE k % 3 = 0 END AS l,
           k % 7 > 0 AS cat, k % 6 > 0 AS m FROM r)
       SELECT k AS o_orderkey, s AS causal_scope_match, l AS causal_locus_match,
         cat AS fault_category_match, m AS mechanism_code_match,
         CASE WHEN c % 3 = 0 THEN k % 8 = 1 END AS causal_operation_match,
         s AND l AND cat AND m AS diagnosis_correct FROM f""",
)
def scoped(t):
    return V.scoped_matches(scoped_runs(t)).select(
        "o_orderkey", "causal_scope_match", "causal_locus_match", "fault_category_match",
        "mechanism_code_match", "causal_operation_match", "diagnosis_correct",
    )


def verdicts(t):
    """Verdicts of the valid citations; the oracle is missing for some cases."""
    rows = resolved(t).where("call_valid")
    at = F.col("ordinal")
    return rows.select(
        "run_id", "query_id", "call_ordinal",
        (at % 3 == 0).alias("baseline_clear"), (at % 4 == 0).alias("anomaly_present"),
        (at % 11 == 0).alias("direct_mechanism"),
        F.col("cited_tool").isin("execute_sql", "query_metrics").alias("verifiable"),
        (F.col("run_id") % 6 > 0).alias("has_oracle"),
    )


VERDICTS = """vd AS (SELECT run_id, query_id, call_ordinal, ordinal % 3 = 0 AS b, ordinal % 4 = 0 AS a,
  ordinal % 11 = 0 AS d, tool IN ('execute_sql', 'query_metrics') AS v, run_id % 6 > 0 AS o
  FROM resolved WHERE call_valid)"""
GROUNDED = """gr AS (SELECT run_id, bool_and(o) AND bool_or(v) AS est, bool_and(o) AS o, bool_or(v) AS v,
  CASE WHEN bool_and(o) AND bool_or(v) THEN bool_or(d) OR (bool_or(b) AND bool_or(a)) END AS mech,
  CASE WHEN bool_and(o) AND bool_or(v) THEN bool_or(a) END AS loc FROM vd GROUP BY run_id)"""


@query(
    "f41_grounding",
    RESOLVED,
    f""", {VERDICTS}, {GROUNDED} SELECT run_id, est AS grounding_estimable,
          CASE WHEN NOT o THEN 'no_deterministic_oracle'
               WHEN NOT v THEN 'grounding_verifier_language_unsupported' END AS not_estimable_reason,
          mech AS mechanism_grounded, loc AS locus_grounded FROM gr""",
)
def grounding(t):
    return V.grounding(verdicts(t))


SUPPORT = """sup AS (SELECT vd.run_id, query_id, bool_or(b) AS b, bool_or(a) AS a, bool_or(d) AS d,
  coalesce(min(mech::INTEGER) = 1, false) AS mech FROM vd JOIN gr ON vd.run_id = gr.run_id
  GROUP BY vd.run_id, query_id HAVING bool_or(a) OR (coalesce(min(mech::INTEGER) = 1, false)
    AND (bool_or(b) OR bool_or(d))))"""


@query(
    "f41_supporting_queries",
    RESOLVED,
    f""", {VERDICTS}, {GROUNDED}, {SUPPORT}
        SELECT run_id, query_id, CASE WHEN a THEN 0 WHEN d THEN 1 ELSE 2 END AS support_class,
          a AS supports_locus, mech AND (a OR b OR d) AS supports_mechanism FROM sup""",
)
def supporting(t):
    rows = verdicts(t)
    return V.supporting_queries(rows, V.grounding(rows))


@query(
    "f42_eligibility",
    "runs",
    """SELECT run_id, diagnosis_correct AND valid_evidence_count > 0 AND tool_calls <= 12
           AND NOT runner_error AND NOT tool_budget_exhausted AND rejected_calls < 3
           AS efficiency_eligible,
         diagnosis_correct AND valid_evidence_count > 0 AND tool_calls <= 12 AND NOT runner_error
           AND NOT tool_budget_exhausted AND rejected_calls < 3 AND citations_execution_valid
           AS auditable_completion FROM runs""",
)
def eligibility(t):
    rows = t.runs.withColumns(
        {
            "tool_calls_executed": F.col("tool_calls"),
            "runner_contract_match": F.lit(True),
            "invalid_calls": F.when(F.col("rejected_calls") >= 3, 1),
        }
    )
    rows = rows.withColumn("execution_reliability", V.execution_reliability(12))
    return rows.select("run_id", *[v.alias(n) for n, v in V.eligibility().items()])


@query(
    "f43_cost_to_evidence",
    RESOLVED,
    f""", {VERDICTS}, {GROUNDED}, {SUPPORT},
        la AS (SELECT c.run_id, max(c.ordinal) AS last FROM calls c JOIN sup
               ON sup.run_id = c.run_id AND sup.query_id = c.query_id GROUP BY c.run_id)
        SELECT c.run_id, last AS last_supporting, count(*) AS calls_through_evidence,
          CASE WHEN count(rows_returned) = count(*) THEN sum(rows_returned)::BIGINT END
            AS rows_through_evidence
        FROM calls c JOIN la ON la.run_id = c.run_id AND c.ordinal <= last GROUP BY c.run_id, last""",
)
def cost_to_evidence(t):
    return V.cost_to_evidence(t.calls, supporting(t))


DISCOVERY = r"""(tool_name = 'describe_table' OR (tool_name = 'execute_sql' AND regexp_matches(lower(sql_text),
  '\b(show\s+(?:full\s+)?(?:databases|schemas|tables)|describe|desc\s+|information_schema\.|pg_catalog\.)')))"""
FIRST = """fi AS (SELECT c.run_id, min(c.ordinal) AS first FROM calls c
  JOIN (SELECT DISTINCT run_id, query_id FROM citations) d ON d.run_id = c.run_id
   AND d.query_id = c.query_id GROUP BY c.run_id)"""


@query(
    "f44_discovery_calls",
    "calls citations",
    f""", {FIRST} SELECT c.run_id, count(*) AS tool_calls_executed,
          count(CASE WHEN {DISCOVERY} THEN 1 END) AS discovery_calls,
          CASE WHEN max(first) IS NOT NULL THEN count(CASE WHEN {DISCOVERY} AND c.ordinal < first THEN 1 END)
            END AS discovery_calls_before_citation
        FROM calls c LEFT JOIN fi ON fi.run_id = c.run_id GROUP BY c.run_id""",
)
def discovery(t):
    return V.call_counts(t.calls, t.citations).select(
        "run_id", "tool_calls_executed", "discovery_calls", "discovery_calls_before_citation"
    )


def rejected_calls(t):
    return t.table("documents").select(
        (F.col("doc_id") % 150).alias("run_id"),
        F.when(F.col("n_chars") % 3 == 0, "invalid").otherwise("superseded").alias("reason_code"),
    )


@query(
    "f45_failed_and_semantic_calls",
    "calls",
    """, rj AS (SELECT doc_id % 150 AS run_id, count(*) AS n FROM documents WHERE n_chars % 3 = 0
               GROUP BY 1)
       SELECT c.run_id, count(CASE WHEN tool_name IN ('describe_table', 'search_table_semantics',
           'query_semantic_graph') THEN 1 END) AS semantic_calls,
         count(CASE WHEN failed THEN 1 END) + coalesce(max(rj.n), 0) AS failed_calls
       FROM calls c LEFT JOIN rj ON rj.run_id = c.run_id GROUP BY c.run_id""",
)
def failed_calls(t):
    return V.call_counts(t.calls, t.citations, rejected_calls(t)).select(
        "run_id", "semantic_calls", "failed_calls"
    )


@query(
    "f46_onset_errors",
    "",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN abs(epoch_us(ts) // 1000000 - 1705276800)::DOUBLE
         WHEN 1 THEN abs(epoch_us(ts) // 1000000 - 1705276800)::DOUBLE
         WHEN 2 THEN abs(epoch_us(ts) // 1000000 + 3600 - 1705276800)::DOUBLE END AS onset_error_seconds
       FROM events""",
)
def onset(t):
    second = W.floor_div("ts_us", 1_000_000)
    iso = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, second.cast("bigint").cast("string"))
        .when(k == 1, F.concat(iso, F.lit("Z")))
        .when(k == 2, F.concat(iso, F.lit("-01:00")))
        .otherwise("around noon")
    )
    return t.events.select(
        "event_id", V.onset_error(text, F.lit(1705276800)).alias("onset_error_seconds")
    )


def _checks(checks, k):
    """One flag per check; check number i fails for every key divisible by i + 5."""
    return {name: k % (at + 5) != 0 for at, name in enumerate(checks)}


def _score_sql(checks):
    flags = [
        "CASE WHEN o_orderkey % 31 = 0 THEN 'tool budget exhausted' END",
        "CASE WHEN o_orderkey % 37 = 0 THEN 'runner error' END",
        *[f"CASE WHEN o_orderkey % {at + 5} = 0 THEN '{c}' END" for at, c in enumerate(checks)],
    ]
    return f"""SELECT o_orderkey, concat_ws(',', {', '.join(flags)}) AS failures,
      concat_ws(',', {', '.join(flags)}) = '' AS success FROM orders"""


def _task(t, checks):
    k = F.col("o_orderkey")
    rows = t.table("orders").select(
        "o_orderkey", (k % 31 == 0).alias("tool_budget_exhausted"),
        (k % 37 == 0).alias("runner_error"),
        *[flag.alias(name) for name, flag in _checks(checks, k).items()],
    )
    return V.task_score(rows, checks).select(
        "o_orderkey", F.array_join("failure_reasons", ",").alias("failures"), "success"
    )


@query("f47_discovery_task_score", "", _score_sql(V.DISCOVERY_CHECKS))
def discovery_score(t):
    return _task(t, V.DISCOVERY_CHECKS)


@query("f48_graph_task_score", "", _score_sql(V.GRAPH_CHECKS))
def graph_score(t):
    return _task(t, V.GRAPH_CHECKS)


def judged_runs(t):
    return t.runs.withColumn("execution_reliability", ~F.col("runner_error"))


QUEUED = """diagnosis_correct AND typed_evidence AND citations_execution_valid AND NOT runner_error
  AND required_evidence_covered IS NOT NULL AND NOT required_evidence_covered"""
PACKET = ["tool_calls", "output_tokens"]
BINDING = ["run_id", "case_id"]
CANDIDATE = """sha256('{"run_id":"' || run_id || '","case_id":' || case_id || '}{"tool_calls":'
  || tool_calls || ',"output_tokens":' || output_tokens || '}')"""


@query(
    "f49_adjudication_queue",
    "runs",
    f"""SELECT {CANDIDATE} AS candidate, run_id, case_id, '{{"tool_calls":' || tool_calls
          || ',"output_tokens":' || output_tokens || '}}' AS judge_input FROM runs WHERE {QUEUED}""",
)
def queue(t):
    return V.adjudication_queue(judged_runs(t), PACKET, BINDING)


JUDGES = ("judge-a", "judge-b")


def decisions(t):
    """Two judges per candidate; some disagree, some candidates lack one judge."""
    runs = judged_runs(t).where(V.needs_adjudication())
    judge = F.explode(F.array(*[F.lit(j) for j in JUDGES]))
    rows = runs.select("run_id", F.col("output_tokens").alias("p"), judge.alias("judge"))
    rows = rows.where(~((F.col("p") % 13 == 0) & (F.col("judge") == "judge-b")))
    second = F.col("judge") == "judge-b"
    return rows.select(
        F.col("run_id").alias("candidate"), "judge",
        F.when(second & (F.col("p") % 3 == 0), F.col("p") % 2 == 0)
        .otherwise(F.col("p") % 2 == 1)
        .alias("sufficient"),
        F.when(second, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1))).cast(
            "array<bigint>"
        ).alias("ordinals"),
    )


def humans(t):
    runs = judged_runs(t).where(V.needs_adjudication()).withColumn("p", F.col("output_tokens"))
    return runs.where((F.col("p") % 3 == 0) & (F.col("p") % 5 > 0)).select(
        F.col("run_id").alias("candidate"), (F.col("p") % 7 > 2).alias("sufficient"),
        F.array(F.lit(3)).cast("array<bigint>").alias("ordinals"),
    )


@query(
    "f50_adjudication_resolution",
    "runs",
    f""", q AS (SELECT run_id, output_tokens AS p FROM runs WHERE {QUEUED}),
        r AS (SELECT run_id, p, p % 2 = 1 AS a, CASE WHEN p % 3 = 0 THEN p % 2 = 0 ELSE p % 2 = 1 END AS b,
                p % 13 > 0 AS complete, p % 3 = 0 AND p % 5 > 0 AS human FROM q),
        s AS (SELECT *, CASE WHEN NOT complete THEN 'judge decisions are incomplete'
             WHEN a = b AND human THEN 'human decision without disagreement'
             WHEN a <> b AND NOT human THEN 'disagreement needs a human decision' END AS problem FROM r)
        SELECT run_id AS candidate, problem, CASE WHEN problem IS NULL THEN
            CASE WHEN a = b THEN a ELSE p % 7 > 2 END END AS sufficient,
          CASE WHEN problem IS NULL THEN CASE WHEN a <> b THEN 'human-tiebreak'
            WHEN a THEN 'unanimous-judge-sufficient' ELSE 'unanimous-judge-insufficient' END END AS basis,
          CASE WHEN problem IS NULL THEN CASE WHEN a = b THEN '1,2' ELSE '3' END END AS ordinals
        FROM s""",
)
def resolution(t):
    queued = judged_runs(t).where(V.needs_adjudication()).select(F.col("run_id").alias("candidate"))
    return V.resolve_adjudication(queued, decisions(t), humans(t), JUDGES).select(
        "candidate", "problem", "sufficient", "basis",
        F.array_join("supporting_ordinals", ",").alias("ordinals"),
    )


@query(
    "f51_adjudication_overlay",
    "runs",
    f""", e AS (SELECT run_id, output_tokens AS p, required_evidence_covered AS c, eligible, {QUEUED} AS queued
               FROM runs)
        SELECT run_id, CASE WHEN queued AND p % 3 = 1 THEN true ELSE c END AS required_evidence_covered,
          CASE WHEN queued AND p % 3 = 1 THEN true ELSE eligible END AS efficiency_eligible,
          queued AND p % 3 <> 1 AS semantic_adjudication_required FROM e""",
)
def overlay(t):
    rows = judged_runs(t)
    evaluations = rows.select(
        "run_id", "required_evidence_covered", F.col("eligible").alias("efficiency_eligible"),
        F.col("eligible").alias("auditable_completion"),
        V.needs_adjudication().alias("semantic_adjudication_required"),
    )
    accepted = rows.select("run_id", (F.col("output_tokens") % 3 == 1).alias("sufficient"))
    return V.apply_adjudication(evaluations, accepted).drop("auditable_completion")


@query(
    "f52_query_load",
    "calls",
    """, m AS (SELECT tool_name, started AS ts_at, 1 AS step FROM calls
              UNION ALL SELECT tool_name, started + elapsed, -1 FROM calls),
       o AS (SELECT tool_name, sum(step) OVER (PARTITION BY tool_name ORDER BY ts_at, step
               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM
             (SELECT tool_name, ts_at, step, row_number() OVER () AS r FROM m))
       SELECT c.tool_name, count(*) AS query_count, count(CASE WHEN failed THEN 1 END) AS failed_query_count,
         coalesce(sum(rows_returned), 0)::BIGINT AS rows_returned,
         sum(elapsed)::BIGINT AS query_elapsed_seconds,
         (SELECT max(open)::BIGINT FROM o WHERE o.tool_name = c.tool_name) AS max_concurrency
       FROM calls c GROUP BY c.tool_name""",
)
def load(t):
    return V.query_load(t.calls, ["tool_name"])


@query(
    "g7_call_positions",
    "calls citations",
    f""", {FIRST} SELECT run_id, first AS first_cited FROM fi""",
)
def positions(t):
    counts = V.call_counts(t.calls, t.citations)
    return counts.where(F.col("first_cited").isNotNull()).select("run_id", "first_cited")


ADJUDICATED = f""", e AS (SELECT run_id, output_tokens AS p, required_evidence_covered AS c, eligible, {QUEUED} AS queued FROM runs)
  SELECT run_id, CASE WHEN queued AND p % 2 = 1 THEN true ELSE c END AS required_evidence_covered,
    CASE WHEN queued AND p % 2 = 1 THEN true ELSE eligible END AS efficiency_eligible,
    queued AND p % 2 = 0 AS semantic_adjudication_required FROM e"""


@query("f51_adjudication_job", "runs", ADJUDICATED)
def adjudication_job(t):
    """Queue, unanimous decisions and overlay in one run of the job."""
    rows = judged_runs(t)
    rows = rows.withColumns({"efficiency_eligible": F.col("eligible"), "auditable_completion": F.col("eligible")})
    doubted = rows.where(V.needs_adjudication())
    decided = doubted.select(
        V.candidate_id(PACKET, BINDING).alias("candidate"), F.explode(F.array(*[F.lit(j) for j in JUDGES])).alias("judge"),
        (F.col("output_tokens") % 2 == 1).alias("sufficient"), F.array(F.lit(1).cast("long")).alias("ordinals"))
    nobody = decided.select("candidate", "sufficient", "ordinals").limit(0)
    done = adjudicated_runs(rows, decided, nobody, JUDGES, PACKET, BINDING)
    return done.select("run_id", "required_evidence_covered", "efficiency_eligible", "semantic_adjudication_required")
