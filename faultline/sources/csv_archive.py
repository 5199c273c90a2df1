"""CSV telemetry archives in the bank, market and telecom layouts.

Headers name the columns; every value is read as text and cast, and files of another column order
are scanned under their own header. Windows of these archives include both ends.
"""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators.collapse import without_collisions

Window = tuple[int, int] | None

# Wide columns of the application files, by layout.
BANK_APP = ("rr", "sr", "cnt", "mrt")
MARKET_SERVICE = ("rr", "sr", "mrt", "count")
TELECOM_APP = ("avg_time", "num", "succee_num", "succee_rate")
# Spellings of a missing parent span.
NO_PARENT = ("", "None", "null")
ARCHIVE_ZONE = "Asia/Shanghai"
#: Headers that are read at the same time.
HEADERS_AT_ONCE = 16


def _csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Text columns by header name; empty fields stay empty text.

    Each path, a file or a folder of part files, has one header; a part file with another one ends
    the job. Paths of equal header are one scan, the scans are joined by column name, and a column
    that some files lack is null there. Only files whose quoted fields hold line breaks need
    `multiline`: such a file cannot be split over tasks.
    """
    reader = (
        spark.read.option("header", "true").option("escape", '"')
        .option("multiLine", str(multiline).lower())
        .option("nullValue", "\u0000").option("emptyValue", "")
    )
    paths = [path] if isinstance(path, str) else path
    # A header is one short job; many files' headers are read side by side.
    with ThreadPoolExecutor(min(HEADERS_AT_ONCE, len(paths))) as pool:
        headers = list(pool.map(lambda each: tuple(reader.csv(each).columns), paths))
    by_header = defaultdict(list)
    for header, each in zip(headers, paths):
        by_header[header].append(each)
    strict = reader.option("enforceSchema", "false")
    scans = [
        strict.schema(", ".join(f"`{c}` string" for c in header)).csv(paths)
        .select("*", _stem().alias("_stem"))
        for header, paths in sorted(by_header.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _stem() -> Column:
    return F.regexp_extract(
        F.col("_metadata.file_path"), r"/([^/]+)\.csv(?:/part-[^/]*)?$", 1
    )


def _inside(rows: DataFrame, ts: Column, window: Window, scale: int) -> DataFrame:
    return rows if window is None else rows.where(W.closed(ts, window[0], window[1], scale))


def _samples(rows: DataFrame, name: Column, ts_ms: Column, value: Column, labels: Column):
    """Finite samples under their folded name.

    A cell that is no number ends the job; NaN and the infinities are left out. The readers end
    the job as well where two source names fold to one.
    """
    number = F.coalesce(
        F.expr("try_cast(_value AS double)"),
        F.raise_error(F.concat(F.lit("not a number: "), F.coalesce("_value", F.lit("null")))).cast("double"),
    )
    staged = rows.select(
        name.alias("source_name"), ts_ms.alias("ts_ms"), value.alias("_value"),
        labels.alias("labels"),
    )
    return staged.select(
        N.fold_metric_name("source_name").alias("metric"), "source_name", "ts_ms",
        number.alias("value"), "labels",
    ).where(N.is_finite("value"))


def _wide(rows: DataFrame, names: tuple[str, ...], ts_ms: Column, labels) -> DataFrame:
    """One row per value column; `labels` builds the map from the metric name."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("v")) for n in names])
    )
    long = rows.select("*", ts_ms.alias("_ts"), cells.alias("_cell"))
    return _samples(
        long, F.col("_cell.n"), F.col("_ts"), F.col("_cell.v"), labels(F.col("_cell.n"))
    )


def read_bank_metrics(
    spark: SparkSession, app: str, container: str, window: Window = None
) -> DataFrame:
    """A5. Application rows give four metrics, container rows one."""
    ts = F.col("timestamp").cast("bigint")
    wide = _inside(_csv(spark, app), ts, window, 1)
    narrow = _inside(_csv(spark, container), ts, window, 1)
    return without_collisions(_wide(
        wide, BANK_APP, ts * 1000, lambda _: F.create_map(F.lit("tc"), "tc")
    ).unionByName(
        _samples(
            narrow, F.col("kpi_name"), ts * 1000, F.col("value"),
            F.create_map(F.lit("cmdb_id"), "cmdb_id"),
        )
    ))


def read_market_metrics(
    spark: SparkSession, service: str, others: list[str], window: Window = None
) -> DataFrame:
    """A6. The service file is wide, the others are long; labels name the file and the kpi."""
    ts = F.col("timestamp").cast("bigint")
    wide = _inside(_csv(spark, service), ts, window, 1)
    narrow = _inside(_csv(spark, others), ts, window, 1)

    def labels(owner: str, kpi: Column) -> Column:
        return F.create_map(
            F.lit(owner), owner, F.lit("metric_source"), "_stem", F.lit("kpi_name"), kpi
        )

    return without_collisions(_wide(wide, MARKET_SERVICE, ts * 1000, lambda n: labels("service", n)).unionByName(
        _samples(
            narrow, F.col("kpi_name"), ts * 1000, F.col("value"), labels("cmdb_id", F.col("kpi_name"))
        )
    ))


def read_telecom_metrics(
    spark: SparkSession, app: str, others: list[str], window: Window = None
) -> DataFrame:
    """A7. Times are milliseconds; kpi rows carry bomc_id and itemid."""
    start = F.col("startTime").cast("bigint")
    ts = F.col("timestamp").cast("bigint")
    wide = _inside(_csv(spark, app), start, window, 1000)
    narrow = _inside(_csv(spark, others), ts, window, 1000)
    return without_collisions(_wide(
        wide, TELECOM_APP, start,
        lambda n: F.create_map(
            F.lit("serviceName"), "serviceName", F.lit("metric_source"), "_stem",
            F.lit("kpi_name"), n,
        ),
    ).unionByName(
        _samples(
            narrow, F.col("name"), ts, F.col("value"),
            F.create_map(
                F.lit("cmdb_id"), "cmdb_id", F.lit("metric_source"), "_stem", F.lit("kpi_name"),
                "name", F.lit("bomc_id"), "bomc_id", F.lit("itemid"), "itemid",
            ),
        )
    ))


def read_csv_logs(
    spark: SparkSession, paths: str | list[str], window: Window = None, with_source: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """A8. Log rows; the market layout adds the file name as the log source.

    `multiline` reads messages with line breaks, at the price of one task per file.
    """
    ts = F.col("timestamp").cast("bigint")
    rows = _inside(_csv(spark, paths, multiline), ts, window, 1)
    labels = [F.lit("cmdb_id"), "cmdb_id", F.lit("log_name"), "log_name"]
    if with_source:
        labels += [F.lit("log_source"), "_stem"]
    return rows.select(
        N.to_nanoseconds(ts).alias("ts_ns"),
        F.coalesce("value", F.lit("")).alias("message"),
        F.create_map(*labels).alias("labels"),
        F.lit("logs").alias("log_table"),
    )


# Attribute names of the source columns, by layout.
SPAN_COLUMNS = {
    "bank": {
        "ts": "timestamp", "trace": "trace_id", "span": "span_id", "parent": "parent_id",
        "attributes": {"source.cmdb_id": "cmdb_id", "source.duration": "duration"},
    },
    "market": {
        "ts": "timestamp", "trace": "trace_id", "span": "span_id", "parent": "parent_span",
        "attributes": {
            "source.cmdb_id": "cmdb_id", "source.duration": "duration", "source.type": "type",
            "source.status_code": "status_code",
        },
    },
    "telecom": {
        "ts": "startTime", "trace": "traceId", "span": "id", "parent": "pid",
        "attributes": {
            "source.cmdb_id": "cmdb_id", "source.elapsed_time": "elapsedTime",
            "source.call_type": "callType", "source.success": "success",
            "source.ds_name": "dsName", "source.service_name": "serviceName",
        },
    },
}


def read_csv_spans(
    spark: SparkSession, path: str | list[str], layout: str, window: Window = None
) -> DataFrame:
    """A9. Spans of zero length without kind and service: what the source lacks is not made up."""
    columns = SPAN_COLUMNS[layout]
    ts = F.col(columns["ts"]).cast("bigint")
    rows = _inside(_csv(spark, path), ts, window, 1000)
    parent = F.coalesce(columns["parent"], F.lit(""))
    if layout == "telecom":
        parent = F.when(parent.isin(*NO_PARENT), "").otherwise(parent)
        name = F.coalesce(F.nullif("serviceName", F.lit("")), "callType", F.lit(""))
    elif layout == "market":
        name = F.coalesce("operation_name", F.lit(""))
    else:
        name = F.lit("")
    ns = ts * F.lit(1_000_000)
    return rows.select(
        F.col(columns["trace"]).alias("trace_id"),
        F.col(columns["span"]).alias("span_id"),
        parent.alias("parent_span_id"),
        name.alias("span_name"),
        F.lit("SPAN_KIND_UNSPECIFIED").alias("span_kind"),
        F.lit("STATUS_CODE_UNSET").alias("status_code"),
        ns.alias("ts_ns"),
        ns.alias("end_ns"),
        F.lit("").alias("service_name"),
        N.renamed_labels(columns["attributes"].items()).alias("attributes"),
    )


def read_ground_truth(spark: SparkSession, path: str, window: Window = None) -> DataFrame:
    """A17. Injected faults of a window, both ends included."""
    ts = F.expr("cast(cast(timestamp AS double) AS bigint)")
    rows = _inside(_csv(spark, path), ts, window, 1)
    return rows.select("level", "component", ts.alias("ts_s"), "reason")


def fault_reasons(spark: SparkSession, path: str) -> DataFrame:
    """A17. Distinct reasons of the whole file."""
    return _csv(spark, path).select("reason").distinct()


def task_windows(tasks: DataFrame, text: str = "instruction") -> DataFrame:
    """A19. Window of a task from its text: a date and exactly two clock times, local time."""
    day = F.regexp_extract(F.col(text), r"([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    clocks = F.regexp_extract_all(F.col(text), F.lit(r"\b(\d{2}:\d{2})\b"), 1)
    sound = (day != "") & (F.size(clocks) == 2)

    def epoch(at: int) -> Column:
        local = F.try_to_timestamp(
            F.concat_ws(" ", day, F.get(clocks, F.lit(at))), F.lit("MMMM d, yyyy HH:mm")
        )
        return F.unix_seconds(F.to_utc_timestamp(local, ARCHIVE_ZONE))

    problem = F.raise_error(F.concat(F.lit("cannot parse task window: "), F.col(text)))
    start = F.when(sound, epoch(0)).otherwise(problem.cast("bigint"))
    return tasks.withColumn("window_start", start).withColumn(
        "window_end", F.when(sound, epoch(1))
    )
