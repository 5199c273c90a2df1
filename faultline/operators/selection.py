"""Case selection: admission, deterministic ranks, quotas and typical cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.skew import bucketed_rank, exact_median, global_rank


def admissions(cases: DataFrame) -> DataFrame:
    """C13. Admission rules of a case row joined from manifest, injection and environment.

    Columns: case_id, hybrid, manifest_kind, state, injection_kind, roots,
    truth_services (arrays), endpoint_source, endpoint_destination (null unless the
    injection is directed), normal_start, normal_end, abnormal_start, abnormal_end,
    injection_time. Every failed rule is listed.
    """
    directed = F.col("endpoint_source").isNotNull()
    root = F.try_element_at("roots", F.lit(1))
    expected = F.when(
        directed, F.array_distinct(F.array("endpoint_source", "endpoint_destination"))
    ).otherwise(F.array(root))
    truth = F.array_distinct(F.filter("truth_services", lambda s: s.isNotNull() & (s != "")))
    rules = {
        "not a single-fault case": ~F.col("hybrid") & (F.col("manifest_kind") != ""),
        "injection did not succeed": F.col("state") == "inject_success",
        "manifest and injection kinds differ": F.col("manifest_kind") == F.col("injection_kind"),
        "case needs exactly one root": F.size("roots") == 1,
        "root disagrees with the injection": (~directed | (root == F.col("endpoint_source")))
        & (F.array_sort(truth) == F.array_sort(expected)),
        "windows are not contiguous": (
            (F.col("normal_start") < F.col("normal_end"))
            & (F.col("normal_end") == F.col("abnormal_start"))
            & (F.col("abnormal_start") < F.col("abnormal_end"))
        ),
        "injection is not at the boundary": F.col("injection_time") == F.col("abnormal_start"),
    }
    failed = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(rule, F.lit(False)), F.lit(reason))
                for reason, rule in rules.items()
            ]
        )
    )
    return cases.withColumn("rejections", failed).withColumn("admitted", F.size("rejections") == 0)


def mechanism_rank(candidates: DataFrame, mechanism: str, case: str, seed: str) -> DataFrame:
    """G1. Rank of a case inside of its mechanism by sha256(seed:mechanism:case).

    The first hex digits of the digest are even buckets, so a mechanism with
    many cases is ranked in parts.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(mechanism), F.col(case)), 256)
    hashed = candidates.withColumn("_digest", digest)
    ranked = bucketed_rank(
        hashed, [mechanism], F.substring("_digest", 1, 3), ["_digest", case], "rank"
    )
    return ranked.drop("_digest")


def seeded_rank(candidates: DataFrame, candidate: str, seed: str) -> DataFrame:
    """G2. Rank of distinct candidates by sha256(seed NUL candidate)."""
    if not seed:
        raise ValueError("selection seed must not be empty")
    digest = F.sha2(F.concat(F.lit(seed + "\0"), F.col(candidate)), 256)
    hashed = candidates.select(candidate).distinct().withColumn("_digest", digest)
    return bucketed_rank(
        hashed, [], F.substring("_digest", 1, 3), ["_digest"], "rank"
    ).drop("_digest")


def quota_table(spark: SparkSession, quotas: dict[tuple, int], stratum: list[str]) -> DataFrame:
    schema = ", ".join(f"{s} string" for s in stratum) + ", quota int"
    return spark.createDataFrame([(*key, n) for key, n in quotas.items()], schema)


def quota_selection(
    ranked: DataFrame, quotas: dict[tuple, int], stratum: list[str], rank: str, passed: str
) -> DataFrame:
    """G4. The first passing cases of every stratum, up to its quota.

    The filter on the largest quota is a constant, so Spark limits every group
    before the shuffle; a large stratum sends only its best rows.
    """
    order = Window.partitionBy(*stratum).orderBy(rank)
    allowed = quota_table(ranked.sparkSession, quotas, stratum)
    best = (
        ranked.where(F.col(passed))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= max(quotas.values()))
    )
    return best.join(allowed, stratum).where(F.col("position") <= F.col("quota"))


def quota_shortfalls(
    selected: DataFrame, quotas: dict[tuple, int], stratum: list[str]
) -> DataFrame:
    """G4. Strata which cannot fill their quota; a shortfall is an error of the selection."""
    counted = selected.groupBy(*stratum).agg(F.count(F.lit(1)).alias("selected"))
    return (
        quota_table(selected.sparkSession, quotas, stratum)
        .join(counted, stratum, "left")
        .na.fill(0, ["selected"])
        .where(F.col("selected") < F.col("quota"))
    )


PROFILE_FIELDS = ("normal_max", "abnormal_max", "peer_abnormal_max")


def typical_cases(profiles: DataFrame, kind: str, case: str) -> DataFrame:
    """G5. Per fault kind the case nearest to the kind's medians (L1 over three fields).

    Rejected profiles (a `rejection` column) take no part. Ties go to the smaller
    id; a kind without measured cases takes its smallest id.
    """
    if "rejection" in profiles.columns:
        profiles = profiles.where(F.col("rejection").isNull())
    measured = profiles.where(F.col(PROFILE_FIELDS[0]).isNotNull())
    # The three medians of a kind in one pass over the fields as rows.
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in PROFILE_FIELDS])
    long = measured.select(kind, F.explode(fields).alias("f")).select(kind, "f.field", "f.v")
    medians = exact_median(long, [kind, "field"], "v", "median").groupBy(kind).agg(
        *[F.max(F.when(F.col("field") == f, F.col("median"))).alias(f"_m_{f}") for f in PROFILE_FIELDS])
    joined = measured.join(medians, kind)
    distance = sum(
        (F.abs(F.col(f) - F.col(f"_m_{f}")) for f in PROFILE_FIELDS[1:]),
        F.abs(F.col(PROFILE_FIELDS[0]) - F.col(f"_m_{PROFILE_FIELDS[0]}")),
    )
    nearest = joined.where(distance.isNotNull()).groupBy(kind).agg(
        F.min(F.struct(distance.alias("d"), F.col(case).alias("c"))).alias("best")
    )
    fallback = profiles.groupBy(kind).agg(F.min(case).alias("smallest"))
    return fallback.join(nearest, kind, "left").select(
        kind, F.coalesce("best.c", "smallest").alias(case)
    )


def eligible_candidates(manifest: DataFrame, kinds: list[str], systems: list[str],
                        exclusions: DataFrame) -> DataFrame:
    """I12. Manifest rows with a known kind, an allowed system, one root, neither hybrid nor excluded."""
    return manifest.where(
        F.col("primary_kind").isin(*kinds)
        & F.col("system").isin(*systems)
        & (F.col("hybrid") == F.lit(False))
        & (F.size("root_services") == 1)
    ).join(exclusions.select("name"), "name", "left_anti")


def unknown_exclusions(exclusions: DataFrame, manifest: DataFrame) -> DataFrame:
    """I11. Exclusions the manifest does not have; must be empty."""
    return exclusions.join(manifest.select("name"), "name", "left_anti")


def score_ranking(scores: DataFrame, name: str, score: str) -> DataFrame:
    """G6. Rank by score descending, then name; rows without a score are left out.

    Ranges of (score, name) are ranked on their own, so a common score is no single task.
    """
    scored = scores.where(F.col(score).isNotNull())
    return global_rank(scored, [F.col(score).desc(), F.col(name).asc()], "rank")
