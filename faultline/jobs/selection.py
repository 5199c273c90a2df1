"""From a manifest to the cases of a measurement."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.skew import global_rank
from faultline.operators import selection as S
from faultline.session import configure, cut_lineage

STRATUM = ["mechanism", "system"]


def select_cases(
    manifest: DataFrame,
    exclusions: DataFrame,
    audits: DataFrame,
    mechanisms: dict[str, str],
    systems: list[str],
    quotas: dict[tuple[str, str], int],
    seed: str,
) -> DataFrame:
    """The first sound cases of every (mechanism, system), up to its quota.

    `manifest`: name, system, primary_kind, hybrid, root_services; `exclusions`: name; `audits`:
    name, passed, of the cases that were audited; `mechanisms` maps fault kinds. Returns name,
    mechanism, system, rank, position and a number from 1 over all, which names the case to whoever
    must not know its source. An exclusion that the manifest lacks, or a stratum that cannot fill
    its quota, ends the job.
    """
    configure(manifest.sparkSession)
    unknown = [r.name for r in S.unknown_exclusions(exclusions, manifest).orderBy("name").limit(10).collect()]
    if unknown:
        raise ValueError(f"exclusions absent from the manifest: {unknown}")
    kind = F.create_map(*chain.from_iterable((F.lit(k), F.lit(m)) for k, m in sorted(mechanisms.items())))
    eligible = S.eligible_candidates(manifest, sorted(mechanisms), systems, exclusions).select(
        "name", "system", kind[F.col("primary_kind")].alias("mechanism"))
    ranked = S.mechanism_rank(eligible, "mechanism", "name", seed)
    # A candidate without an audit cannot pass.
    audited = ranked.join(audits.select("name", "passed"), "name", "left")
    chosen = cut_lineage(S.quota_selection(audited, quotas, STRATUM, "rank", "passed"), "selection")
    short = S.quota_shortfalls(chosen, quotas, STRATUM).orderBy(*STRATUM).collect()  # at most one row per quota
    if short:
        raise ValueError(f"quotas not met: {[(r.mechanism, r.system, r.selected, r.quota) for r in short]}")
    return global_rank(chosen.select("name", *STRATUM, "rank", "position"), ["mechanism", "rank"], "number")


def typical_of(selected: DataFrame, profiles: DataFrame) -> DataFrame:
    """G5. Of the selected cases, the most typical one per mechanism; `profiles` has name and its facts."""
    return S.typical_cases(selected.select("name", "mechanism").join(profiles, "name"), "mechanism", "name")
