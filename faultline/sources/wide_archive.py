"""Wide Parquet telemetry archives: one row per point, log record or span (A1-A4).

Files carry their period in the name (`normal_*`, `abnormal_*`) and any number
of `attr.*` columns. Times are nanoseconds; with the session settings of
`faultline.session` a nanosecond Parquet timestamp arrives as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import normalize as N


# Core columns of the signals; `attr.*` columns differ by archive.
POINT = "time bigint, metric string, value double, service_name string"
HISTOGRAM = "time bigint, metric string, service_name string, count double, sum double, min double, max double"
LOG = "time bigint, service_name string, message string, trace_id string, span_id string, level string"
SPAN = (
    "time bigint, trace_id string, span_id string, parent_span_id string, span_name string, "
    "`attr.span_kind` string, service_name string, duration decimal(20,0), `attr.status_code` string"
)


def _scan(spark: SparkSession, paths: list[str], core: str, attributes: list[str] | None) -> DataFrame:
    """All files of a signal in one scan, with period and source order.

    With the archive's attribute names the schema is declared: no footer is read before the job,
    and a column that a file lacks is null. Without them the footers of all files are merged.
    """
    if attributes is None:
        rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    else:
        declared = [core, *[f"`attr.{name}` string" for name in attributes]]
        rows = spark.read.schema(", ".join(declared)).parquet(*paths)
    path = F.col("_metadata.file_path")
    # The period starts the file name, or the folder name when Spark wrote the file.
    period = F.regexp_extract(path, r"/(abnormal|normal)[^/]*(/part-[^/]*)?$", 1)
    return rows.select(
        "*",
        F.when(period == "abnormal", 1).otherwise(0).alias("period_order"),
        path.alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def _optional(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def _text(column: Column) -> Column:
    return F.nullif(column.cast("string"), F.lit(""))


SOURCE_ORDER = ["period_order", "kind_order", "file", "row_index"]


def _period() -> Column:
    return F.when(F.col("period_order") == 0, "normal").otherwise("abnormal").alias("period")


def read_numbers(
    spark: SparkSession, paths: list[str], kind: str = "gauge", attributes: list[str] | None = None
) -> DataFrame:
    """A1. Gauge or sum points; a value that is not finite ends the job.

    Gauges come before sums in source order.
    """
    rows = _scan(spark, paths, POINT, attributes)
    return rows.select(
        F.col("metric").cast("string").alias("metric"),
        F.col("time").cast("bigint").alias("ts_ns"),
        N.finite_or_fail("value").alias("value"),
        _text(_optional(rows, "service_name")).alias("service_name"),
        N.attribute_map(rows.columns).alias("attributes"),
        F.lit(kind).alias("kind"),
        F.lit(0 if kind == "gauge" else 1).alias("kind_order"),
        _period(), "period_order", "file", "row_index",
    )


def read_histograms(
    spark: SparkSession, paths: list[str], attributes: list[str] | None = None
) -> DataFrame:
    """A2. Histogram points; the count must be finite, whole and not negative."""
    rows = _scan(spark, paths, HISTOGRAM, attributes)
    count = F.col("count").cast("double")
    sound = N.is_finite(count) & (count >= 0) & (count == F.floor(count))
    problem = F.raise_error(F.concat(F.lit("invalid histogram count: "), count.cast("string")))
    return rows.select(
        F.col("metric").cast("string").alias("metric"),
        F.col("time").cast("bigint").alias("ts_ns"),
        F.when(F.coalesce(sound, F.lit(False)), count.cast("bigint"))
        .otherwise(problem.cast("bigint"))
        .alias("count"),
        *[
            N.finite_or_fail(_optional(rows, f, "double"), f"non-finite histogram {f}").alias(f)
            for f in ("sum", "min", "max")
        ],
        _text(_optional(rows, "service_name")).alias("service_name"),
        N.attribute_map(rows.columns).alias("attributes"),
        F.lit("histogram").alias("kind"),
        F.lit(2).alias("kind_order"),
        _period(), "period_order", "file", "row_index",
    )


def point_labels(points: DataFrame) -> DataFrame:
    """Folded label map of a point: service name, attributes and the derived identity."""
    service = N.drop_empty(F.create_map(F.lit("service.name"), "service_name"))
    source = F.map_concat(service, "attributes")
    return points.withColumn(
        "labels",
        F.map_concat(N.fold_label_map(source), N.service_identity(source)),
    )


def read_logs(spark: SparkSession, paths: list[str], attributes: list[str] | None = None) -> DataFrame:
    """A3. Log records; labels are service, attributes and the non-empty correlation fields."""
    rows = _scan(spark, paths, LOG, attributes)
    extra = N.renamed_labels((n, _optional(rows, n)) for n in ("trace_id", "span_id", "level"))
    labels = F.map_concat(
        F.create_map(F.lit("service_name"), F.col("service_name").cast("string")),
        N.attribute_map(rows.columns),
        N.drop_empty(extra),
    )
    return rows.select(
        F.col("time").cast("bigint").alias("ts_ns"),
        F.coalesce(_optional(rows, "message"), F.lit("")).alias("message"),
        labels.alias("labels"),
        F.lit("logs").alias("log_table"),
        _period(),
    )


def read_spans(spark: SparkSession, paths: list[str], attributes: list[str] | None = None) -> DataFrame:
    """A4. Spans; unknown enums, a negative duration or a missing service end the job."""
    rows = _scan(spark, paths, SPAN, attributes)
    duration = F.col("duration").cast("bigint")
    problem = F.raise_error(F.lit("negative span duration")).cast("bigint")
    checked = F.when(duration < 0, problem).otherwise(duration)
    kind = N.span_kind_code(F.col("`attr.span_kind`").cast("string"))
    status = N.status_code(F.col("`attr.status_code`").cast("string"))
    service = _text(_optional(rows, "service_name"))
    unnamed = F.raise_error(F.lit("span has no service_name")).cast("string")
    return rows.select(
        F.col("trace_id").cast("string").alias("trace_id"),
        F.col("span_id").cast("string").alias("span_id"),
        F.coalesce(_optional(rows, "parent_span_id"), F.lit("")).alias("parent_span_id"),
        F.col("span_name").cast("string").alias("span_name"),
        N.span_kind_name(kind).alias("span_kind"),
        N.status_name(status).alias("status_code"),
        F.col("time").cast("bigint").alias("ts_ns"),
        N.span_end(F.col("time"), checked).alias("end_ns"),
        F.coalesce(service, unnamed).alias("service_name"),
        N.attribute_map(rows.columns, excluded=("span_kind", "status_code")).alias("attributes"),
        _period(),
    )
