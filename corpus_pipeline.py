"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept and returns the columns of `documents`;
the last returns packed pieces. Rows are documents; a null doc_id counts as a negative number
made of the text. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import common, decontaminate, packing, quality, queries, secrets, simhash
from faultline.session import cut_lineage

#: SQL cannot express SimHash, trained scores or byte-pair ids; tests use brute force instead.
ORACLE_SQL = None

_MARK, _OWN, _BODY = "_pipeline_mark", "_pipeline_own", "_pipeline_body"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    common.prepare(spark)
    model = queries.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_column(docs, model, _MARK).where(F.col(_MARK) >= queries.ACCEPT).drop(_MARK)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: the smallest id's, of several the one with the
    smallest hash of its text.

    Rows are grouped by their own fingerprints: rows of one id with unrelated texts are in different
    groups, and each group keeps a row.
    """
    common.prepare(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id"), F.xxhash64(body).bitwiseOR(F.lit(-(1 << 63))))
    # A row's name is a hash of its id and text; equal rows share one.
    marked = docs.withColumns({_MARK: F.xxhash64(own, body), _OWN: own, _BODY: F.xxhash64(body)})
    named = marked.groupBy(_MARK).agg(F.min(_OWN).alias(_OWN), F.min(_BODY).alias(_BODY))
    found = simhash.near_duplicates(marked.select(F.col(_MARK).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(_MARK), "component_id").distinct()
    kept = groups.join(named, _MARK).groupBy("component_id").agg(
        F.min(F.struct(_OWN, _BODY, _MARK)).alias("least")).select(F.col("least")[_MARK].alias(_MARK))
    rows = marked.join(kept, _MARK, "left_semi").dropDuplicates([_MARK])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain enough of a benchmark."""
    common.prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.mark_contaminated(docs, benchmark, into=_MARK)
    return marked.where(~F.col(_MARK)["contaminated"]).drop(_MARK)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; documents stay."""
    common.prepare(spark)
    found = secrets.scan(docs, into=_MARK)
    clean = F.col(_MARK)["clean"]
    text = F.coalesce(clean, F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(clean.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return found.drop(_MARK)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    common.prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
