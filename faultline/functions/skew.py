"""Exact group statistics that do not put a hot group into one task.

One key may hold a large share of all rows. The functions below fold equal
values before the shuffle, find a narrow bracket with a mergeable sketch, and
order only what lies inside of the bracket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage

SKETCH_ACCURACY = 10_000
# Half width of the bracket in rank fractions; ten times the sketch's rank error.
BRACKET = 10 / SKETCH_ACCURACY
# Parts of a bracket that are ranked on their own.
SLICES = 256


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality on all keys of two aliased frames."""
    return reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    )


def exact_median(
    rows: DataFrame, keys: list[str], value: str, out: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Exact median per group, the mean of the middle two for an even count.

    Groups without a non-null value are absent from the result. `extra` names
    further aggregates over the non-null values, as column `_v`; they ride along
    in the pass that sizes the groups. The values are written once, because two passes
    read them, and what lies in the bracket is ranked by slices of it.
    """
    extra = extra or {}
    values = cut_lineage(
        rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null"), "values"
    )
    bracket = F.percentile_approx(
        "_v", F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET)), SKETCH_ACCURACY
    )
    sizes = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        bracket.alias("_b"),
        *[column.alias(name) for name, column in extra.items()],
    )
    joined = values.alias("l").join(sizes.alias("r"), same_keys(values, sizes, keys)).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "_v", "_total", *extra,
        F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high"),
    )
    # Rows below the bracket only count; equal values inside of it fold into one row.
    below = F.col("_v") < F.col("_low")
    folded = (
        joined.where(F.col("_v") <= F.col("_high"))
        .groupBy(*keys, "_total", *extra, "_low", "_high", F.when(~below, F.col("_v")).alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    width = F.col("_high") - F.col("_low")
    slice_ = F.when(F.col("_slot").isNull(), -1).when(
        width > 0, F.floor((F.col("_slot") - F.col("_low")) / width * SLICES)
    ).otherwise(0)
    ranked = running_sum(folded, keys, slice_, [F.col("_slot").asc_nulls_first()], "_n", "_cum")
    first = F.floor((F.col("_total") + 1) / 2)
    second = F.floor((F.col("_total") + 2) / 2)
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_cum") >= first, F.col("_slot")))
                + F.min(F.when(F.col("_cum") >= second, F.col("_slot")))
            )
            / 2
        ).alias(out),
        *[F.max(name).alias(name) for name in extra],
    )


def running_max(
    rows: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[str],
    value: str,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running maximum per group in `order`, computed bucket by bucket.

    `bucket` must rise with `order`. Every (keys, bucket) pair is its own
    window partition; what earlier buckets contribute comes from one row per
    bucket, so a hot group is spread over its buckets.
    """
    peaks = rows.groupBy(*keys, bucket).agg(F.max(value).alias("_peak"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = peaks.withColumn("_carry", F.max("_peak").over(earlier)).drop("_peak")
    joined = rows.alias("l").join(carry.alias("r"), same_keys(rows, carry, [*keys, bucket]))
    inside = (
        Window.partitionBy(*keys, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return joined.select("l.*", "_carry").select(
        *rows.columns, F.greatest("_carry", F.max(value).over(inside)).alias(out)
    )


def bucketed_rank(
    rows: DataFrame, keys: list[str], bucket: Column, order: list, out: str
) -> DataFrame:
    """Row number per group in `order`, computed bucket by bucket.

    `bucket` must rise with `order`; earlier buckets contribute their sizes.
    """
    tagged = rows.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    ).drop("_size")
    on = same_keys(tagged, offsets, [*keys, "_bucket"])
    joined = tagged.alias("l").join(offsets.alias("r"), on).select("l.*", "_before")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return joined.select(
        *rows.columns, (F.col("_before") + F.row_number().over(inside)).alias(out)
    )


def global_rank(rows: DataFrame, order: list, out: str) -> DataFrame:
    """Row number over all rows in `order`, by ranges of the order itself.

    Rows are dealt to ranges by all columns of the order, so ties in the first ones are split too,
    and are written once with their range: a second run could draw other borders. What earlier
    ranges contribute comes from one row per range.
    """
    placed = cut_lineage(
        rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    return bucketed_rank(placed, [], F.col("_range"), order, out).drop("_range")


def running_sum(
    rows: DataFrame, keys: list[str], bucket: Column, order: list, value: str, out: str
) -> DataFrame:
    """Inclusive running sum per group in `order`, computed bucket by bucket.

    `bucket` must rise with `order`; earlier buckets contribute their totals.
    """
    tagged = rows.withColumn("_bucket", bucket)
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    ).drop("_total")
    on = same_keys(tagged, carry, [*keys, "_bucket"])
    joined = tagged.alias("l").join(carry.alias("r"), on).select("l.*", "_before")
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return joined.select(
        *rows.columns, (F.col("_before") + F.sum(value).over(inside)).alias(out)
    )
