"""Case metadata: topology, manifest and recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPOLOGY = (
    "entities array<struct<id:string,type:string,name:string>>, "
    "edges array<struct<src:string,dst:string,relation:string>>"
)
MANIFEST = (
    "name string, system string, root_services array<string>, primary_kind string, hybrid boolean"
)
LOAD = (
    "struct<query_count:bigint,failed_query_count:bigint,rows_returned:bigint,"
    "query_elapsed_seconds:double,max_concurrency:bigint>"
)
RUNS = (
    "cell_index bigint, model string, case_id string, repetition int, visibility string, "
    "run struct<model:string,error:string,tool_budget_exhausted:boolean,"
    "tool_calls_requested:bigint,usage:struct<input_tokens:bigint,output_tokens:bigint,"
    "reasoning_tokens:bigint>,"
    "diagnosis:struct<causal_scope:string,causal_component:string,edge_source:string,"
    "edge_destination:string,fault_category:string,fault_type:string,mechanism_code:string,"
    "causal_operation:string,onset_time:string,"
    "evidence:array<struct<query_id:string,claim:string,claim_types:array<string>>>>,"
    "tool_calls:array<struct<query_id:string,tool_name:string,input:map<string,string>,"
    "output:struct<query_id:string,operation:string,truncated:boolean>,error:string,"
    "base_tables:array<string>,"
    f"database_load:{LOAD}>>,"
    "rejected_tool_calls:array<struct<tool_name:string,reason_code:string>>,"
    "responses:array<struct<usage:string>>>"
)


def read_topology(spark: SparkSession, path: str, one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """A15. Entities and edges of topology snapshots: one JSON document per file, or one per line,
    which can be split over tasks."""
    snapshot = spark.read.schema(TOPOLOGY).option("multiLine", str(one_per_file).lower()).json(path)
    entities = snapshot.select(F.explode("entities").alias("e")).select("e.*")
    edges = snapshot.select(F.explode("edges").alias("e")).select("e.*")
    return entities.where(F.coalesce("id", F.lit("")) != ""), edges


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A16. One case per line."""
    return spark.read.schema(MANIFEST).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A18. Recorded runs, one JSON record per line, with a run id from the cell."""
    return spark.read.schema(RUNS).json(path).withColumn(
        "run_id", F.col("cell_index").cast("string")
    )


def parted_runs(runs: DataFrame) -> DataFrame:
    """A18. Runs with two lists for their calls, so that one pass over the records serves calls and runs.

    `calls` has what counts ask of every call; `named` has place and whole record of those whose id the
    run cites, as only these can be evidence. A run id is taken to name one record.
    """
    calls, cited = F.col("run.tool_calls"), F.col("run.diagnosis.evidence.query_id")
    placed = F.transform(calls, lambda c, at: F.struct(at.alias("at"), c.alias("c")))
    return runs.select(
        *[c for c in runs.columns if c != "run"], F.col("run").dropFields("tool_calls").alias("run"),
        F.transform(calls, lambda c: F.struct(*[v.alias(n) for n, v in counted_facts(c).items()])).alias("calls"),
        F.filter(placed, lambda p: F.array_contains(cited, p["c"]["query_id"])).alias("named"),
    )


def counted_facts(call: Column) -> dict[str, Column]:
    """A18/G7. What counts ask of the record of a call."""
    return {
        "tool_name": call["tool_name"],
        "failed": call["error"].isNotNull(),
        "sql_text": F.coalesce(call["input"]["query"], call["input"]["sql"]),
        # Null when no load was recorded, which is not zero rows.
        "rows_returned": call["database_load"]["rows_returned"],
    }


def counted_calls(runs: DataFrame) -> DataFrame:
    """A18/G7. Every call of `parted_runs` with its ordinal and what counts ask of it."""
    calls = runs.select("run_id", F.posexplode("calls").alias("at", "c"))
    return calls.select("run_id", (F.col("at") + 1).alias("ordinal"), "c.*")


def named_calls(runs: DataFrame) -> DataFrame:
    """A18/G7. The columns of `run_calls` for those calls of `parted_runs` that their run cites."""
    return described_calls(runs.select("run_id", "visibility", F.explode("named").alias("n")).select(
        "run_id", "visibility", "n.at", "n.c"))


def run_calls(runs: DataFrame) -> DataFrame:
    """A18/G7. Tool calls with their ordinal; calls without recorded tables read none."""
    return described_calls(runs.select("run_id", "visibility", F.posexplode("run.tool_calls").alias("at", "c")))


def described_calls(calls: DataFrame) -> DataFrame:
    """A18/G7. The columns of `run_calls` from place and record of each call."""
    facts = counted_facts(F.col("c"))
    return calls.select(
        "run_id",
        F.col("visibility").alias("treatment"),
        (F.col("at") + 1).alias("ordinal"),
        "c.query_id",
        "c.tool_name",
        F.coalesce("c.output.operation", F.col("c.input")["operation"]).alias("operation"),
        facts["failed"].alias("failed"),
        F.col("c.output.query_id").alias("result_query_id"),
        F.col("c.output.truncated").alias("truncated"),
        facts["sql_text"].alias("sql_text"),
        F.coalesce("c.base_tables", F.array().cast("array<string>")).alias("base_tables"),
        F.to_json(F.array_sort(F.map_entries("c.input"))).alias("arguments"),
        facts["rows_returned"].alias("rows_returned"),
    )


def run_citations(runs: DataFrame) -> DataFrame:
    """A18. Cited evidence with its ordinal; runs without a diagnosis have none."""
    cited = runs.select("run_id", F.posexplode("run.diagnosis.evidence").alias("at", "e"))
    return cited.select(
        "run_id", (F.col("at") + 1).alias("ordinal"), "e.query_id",
        F.coalesce("e.claim", F.lit("")).alias("claim"),
        F.coalesce("e.claim_types", F.array().cast("array<string>")).alias("claim_types"),
    )


def run_responses(runs: DataFrame) -> DataFrame:
    """A18. Provider responses; `explode_outer` keeps runs without any response."""
    return runs.select("run_id", F.posexplode_outer("run.responses").alias("at", "r")).select(
        "run_id", (F.col("at") + 1).alias("ordinal"), "r.usage"
    )


def run_rejections(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode("run.rejected_tool_calls").alias("r")).select(
        "run_id", "r.tool_name", "r.reason_code"
    )
