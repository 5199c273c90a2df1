"""Paired comparison of treatments and its exact statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.skew import SLICES, exact_median, running_max, running_sum
from faultline.functions.statistics import relative_change, sign_test


def arm_pairs(
    runs: DataFrame, keys: list[str], arm: str, baseline: str, treatment: str, values: list[str]
) -> DataFrame:
    """E10. One row per key with `b_` and `t_` columns; a missing arm leaves a null marker.

    A conditional aggregate replaces the self join: one shuffle, combined map-side.
    """
    parts = []
    for prefix, name in (("b", baseline), ("t", treatment)):
        here = F.col(arm) == name
        parts.append(F.count_if(here).alias(f"{prefix}_runs"))
        parts += [F.max(F.when(here, F.col(v))).alias(f"{prefix}_{v}") for v in values]
    return runs.where(F.col(arm).isin(baseline, treatment)).groupBy(*keys).agg(*parts)


def incomplete_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """E10. Keys without exactly one run per arm; they are an error of the measurement."""
    return pairs.where((F.col("b_runs") != 1) | (F.col("t_runs") != 1)).select(
        *keys, "b_runs", "t_runs"
    )


def pair_deltas(
    pairs: DataFrame,
    keys: list[str],
    metrics: list[str],
    eligible: str,
    baseline: str,
    treatment: str,
    zero_for_null: tuple[str, ...] = (),
) -> DataFrame:
    """F59/F64. Deltas and relative changes of complete pairs, null unless both are eligible.

    A null measure stays null, except for the token counts in `zero_for_null`.
    """
    complete = pairs.where((F.col("b_runs") == 1) & (F.col("t_runs") == 1))
    b, t = F.col(f"b_{eligible}"), F.col(f"t_{eligible}")
    both = F.coalesce(b & t, F.lit(False))
    status = (
        F.when(both, "both")
        .when(F.coalesce(b, F.lit(False)), f"{baseline}_only")
        .when(F.coalesce(t, F.lit(False)), f"{treatment}_only")
        .otherwise("neither")
    )
    columns: list[Column] = []
    for metric in metrics:
        low, high = F.col(f"b_{metric}"), F.col(f"t_{metric}")
        if metric in zero_for_null:
            low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))
        delta = F.when(both, high - low)
        columns.append(delta.alias(metric))
        columns.append(relative_change(delta, low).alias(f"{metric}_relative"))
    return complete.select(*keys, both.alias("eligible"), status.alias("status"), *columns)


def case_effects(deltas: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """F60. Median of the eligible pairs per case, long: keys, metric, case_median.

    Ratios are reduced pair by pair and then per case, never as a ratio of medians.
    """
    names = [c for m in metrics for c in (m, f"{m}_relative")]
    long = deltas.where("eligible").select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v"))
                    for n in names
                ]
            )
        ).alias("m"),
    )
    return exact_median(
        long.select(*keys, "m.metric", "m.v"), [*keys, "metric"], "v", "case_median"
    )


def directions(value: Column | str) -> dict[str, Column]:
    """F61. Aggregates: negative, tied and positive values."""
    v = F.col(value) if isinstance(value, str) else value
    return {
        "eligible_cases": F.count(v),
        "negative_cases": F.count_if(v < 0),
        "tied_cases": F.count_if(v == 0),
        "positive_cases": F.count_if(v > 0),
    }


def described(effects: DataFrame, groups: list[str], value: str) -> DataFrame:
    """F60/F61. Median and direction counts per group, from one sizing pass."""
    return exact_median(effects, groups, value, "case_median_delta", directions("_v"))


def effect_summary(effects: DataFrame, keys: list[str], value: str = "case_median") -> DataFrame:
    """F60-F62. Median over the cases, direction counts and the sign test."""
    return described(effects, [*keys, "metric"], value).withColumn(
        "sign_test_p", sign_test("negative_cases", "positive_cases")
    )


#: Slices of p below the first even one, for each factor of e.
SLICES_PER_E = 16


def _slice_of(p: Column) -> Column:
    """Slices of p that rise with it: even ones, and even ones of its logarithm below the first.

    Many tests have a very small p; even slices alone would put them all into one.
    """
    small = F.floor((F.ln(p) + math.log(SLICES)) * SLICES_PER_E).cast("bigint") - 1
    return F.when(p >= 1.0 / SLICES, F.floor(p * SLICES)).when(p > 0, small).otherwise(F.lit(-(1 << 40)))


def holm(
    tests: DataFrame, family: list[str], p: str, size: Column | int, overfull: bool = False
) -> DataFrame:
    """F63/G3. Holm adjustment inside of families of a declared size.

    Tests with equal p share one adjusted value, so the tests fold to distinct p
    before any order is built; running sums and maxima go by slices of p, so that a large
    family is not one task. More tests than the declared size end the job; with `overfull` they
    keep the formula, whose factor falls below one there, so that the running maximum decides.
    """
    declared = F.lit(size) if isinstance(size, int) else size
    tagged = tests.withColumn("_m", declared.cast("bigint"))
    folded = tagged.where(F.col(p).isNotNull()).groupBy(*family, p).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_m").alias("_m")
    )
    sliced = folded.withColumn("_slice", _slice_of(F.col(p)))
    counted = running_sum(sliced, family, F.col("_slice"), [p], "_n", "_so_far")
    step = F.col(p) * (F.col("_m") - F.col("_so_far") + F.col("_n"))
    if not overfull:
        # The last test of a family sees them all, so this is where too many show.
        problem = F.raise_error(F.lit("family has more tests than it declares")).cast("double")
        step = F.when(F.col("_so_far") > F.col("_m"), problem).otherwise(step)
    stepped = counted.withColumn("_a", step)
    adjusted = running_max(stepped, family, "_slice", [p], "_a", "_top").select(
        *family, p, F.least(F.lit(1.0), F.col("_top")).alias("holm_adjusted_p")
    )
    return tagged.drop("_m").join(adjusted, [*family, p], "left")


def relative_by_model(effects: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """F94. Median relative change in percent per model, with the case count."""
    rows = effects.where(F.col("metric") == f"{metric}_relative")
    middle = exact_median(rows, keys, "case_median", "_median", {"cases": F.count("_v")})
    return middle.select(*keys, "cases", (F.col("_median") * 100.0).alias("percent"))


def reduction_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """F94. How many measured models fell, and by how much."""
    fell = F.when(F.col("percent") < 0, -F.col("percent"))
    return rows.groupBy(*keys).agg(
        F.count("percent").alias("models"),
        F.count(fell).alias("reduced"),
        F.min(fell).alias("smallest"),
        F.max(fell).alias("largest"),
    )


def overlay(base: DataFrame, replacements: DataFrame, key: str, schedule: list[str]) -> DataFrame:
    """E12. Rerun cells replace old ones.

    The job ends if a cell has several replacements, if its cell is unknown, or if a schedule field
    differs between both.
    """
    new = replacements.groupBy(key).agg(
        F.count(F.lit(1)).alias("_times"), F.first(F.struct(*base.columns)).alias("_new")
    )
    joined = base.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    replaced = F.col("n._times").isNotNull()
    known = F.col(f"o.{key}").isNotNull()
    drift = F.lit(False)
    for field in schedule:
        drift = drift | ~F.col(f"o.{field}").eqNullSafe(F.col(f"n._new.{field}"))
    problem = (
        F.when(replaced & ~known, "replacement of an unknown cell")
        .when(F.col("n._times") > 1, "several replacements of one cell")
        .when(replaced & drift, "replacement schedule differs")
    )
    sound = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    kept = [
        F.when(replaced, F.col(f"n._new.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in base.columns
    ]
    return joined.where(sound).select(*kept, replaced.alias("replaced"))


def disposition(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """F64. Pairs per eligibility status."""
    return deltas.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("pairs"))


def success_pairs(pairs: DataFrame, keys: list[str], success: str) -> DataFrame:
    """F79. Improvements, regressions and ties of task success over run pairs."""
    b = F.coalesce(F.col(f"b_{success}"), F.lit(False))
    t = F.coalesce(F.col(f"t_{success}"), F.lit(False))
    complete = pairs.where((F.col("b_runs") >= 1) & (F.col("t_runs") >= 1))
    return complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paired_observations"),
        F.count_if(t & ~b).alias("improvements"),
        F.count_if(b & ~t).alias("regressions"),
        F.count_if(t == b).alias("ties"),
    )
