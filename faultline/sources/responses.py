"""Archived store responses as JSON text, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SERIES = (
    "array<struct<metric:map<string,string>,stream:map<string,string>,value:array<string>,"
    "values:array<array<string>>>>"
)


def flatten_matrix(responses: DataFrame, body: str) -> DataFrame:
    """A20. Scalar, vector and matrix results as one row per sample.

    A scalar has no labels. Samples with fewer than two parts are skipped.
    """
    rest = [c for c in responses.columns if c != body]
    kind = F.get_json_object(body, "$.data.resultType")
    result = F.get_json_object(body, "$.data.result")
    none = F.expr("cast(map() AS map<string,string>)")
    series = F.from_json(F.when(~kind.isin("scalar", "string"), result), _SERIES)
    from_series = F.flatten(
        F.transform(
            series,
            lambda s: F.transform(
                F.when(s["values"].isNotNull(), s["values"]).otherwise(F.array(s["value"])),
                lambda v: F.struct(F.coalesce(s["metric"], none).alias("labels"), v.alias("v")),
            ),
        )
    )
    alone = F.from_json(F.when(kind.isin("scalar", "string"), result), "array<string>")
    from_scalar = F.when(alone.isNotNull(), F.array(F.struct(none.alias("labels"), alone.alias("v"))))
    samples = responses.select(*rest, F.explode(F.coalesce(from_series, from_scalar)).alias("s"))
    return samples.where(F.size("s.v") >= 2).select(
        *rest,
        "s.labels",
        F.get("s.v", F.lit(0)).cast("double").alias("timestamp"),
        F.get("s.v", F.lit(1)).alias("value"),
    )


def flatten_log_streams(responses: DataFrame, body: str) -> DataFrame:
    """A21. Log streams as one row per entry; an entry's own metadata replaces stream labels."""
    rest = [c for c in responses.columns if c != body]
    streams = F.from_json(F.get_json_object(body, "$.data.result"), _SERIES)
    entries = responses.select(*rest, F.explode(streams).alias("s")).select(
        *rest,
        F.coalesce("s.stream", "s.metric", F.expr("cast(map() AS map<string,string>)")).alias("l"),
        F.explode("s.values").alias("v"),
    )
    metadata = F.coalesce(
        F.from_json(F.get("v", F.lit(2)), "map<string,string>"),
        F.expr("cast(map() AS map<string,string>)"),
    )
    return entries.where(F.size("v") >= 2).select(
        *rest,
        F.map_concat("l", metadata).alias("labels"),
        F.get("v", F.lit(0)).cast("bigint").alias("ts_ns"),
        F.get("v", F.lit(1)).alias("line"),
    )


_VALUE = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
    "bytesValue:string,arrayValue:string,kvlistValue:string>"
)
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_EXPORT = (
    f"batches array<struct<resource:struct<attributes:{_ATTRIBUTES}>,"
    "scopeSpans:array<struct<scope:struct<name:string,version:string>,"
    "spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,"
    "kind:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"status:struct<code:string>,attributes:{_ATTRIBUTES}>>>>>>"
)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(F.unbase64(F.coalesce(value, F.lit("")))))


def _attributes(items: Column) -> Column:
    """Typed attribute values as canonical text; a value of no or several types is null."""

    def text(value: Column) -> Column:
        parts = [
            value["stringValue"],
            value["boolValue"].cast("string"),
            value["intValue"],
            value["doubleValue"].cast("string"),
            value["bytesValue"],
            value["arrayValue"],
            value["kvlistValue"],
        ]
        present = F.array_compact(F.array(*parts))
        return F.when(F.size(present) == 1, F.get(present, F.lit(0)))

    empty = F.array().cast(_ATTRIBUTES)
    pairs = F.transform(
        F.coalesce(items, empty), lambda a: F.struct(a["key"].alias("key"), text(a["value"]))
    )
    return F.map_from_entries(pairs)


def flatten_trace_export(responses: DataFrame, body: str) -> DataFrame:
    """A22. Exported traces as one row per span; a batch without a service name ends the job."""
    rest = [c for c in responses.columns if c != body]
    batches = responses.select(
        *rest, F.explode(F.from_json(body, _EXPORT)["batches"]).alias("b")
    ).select(*rest, _attributes(F.col("b.resource.attributes")).alias("resource"), "b.scopeSpans")
    scopes = batches.select(*rest, "resource", F.explode("scopeSpans").alias("sc"))
    spans = scopes.select(
        *rest, "resource", F.col("sc.scope.name").alias("scope_name"),
        F.explode("sc.spans").alias("s"),
    )
    service = F.nullif(F.col("resource")["service.name"], F.lit(""))
    unnamed = F.raise_error(F.lit("exported span has no service.name")).cast("string")
    return spans.select(
        *rest,
        _hex(F.col("s.traceId")).alias("trace_id"),
        _hex(F.col("s.spanId")).alias("span_id"),
        _hex(F.col("s.parentSpanId")).alias("parent_span_id"),
        F.coalesce("s.name", F.lit("")).alias("span_name"),
        F.coalesce("s.kind", F.lit("SPAN_KIND_UNSPECIFIED")).alias("span_kind"),
        F.coalesce("s.status.code", F.lit("STATUS_CODE_UNSET")).alias("status_code"),
        F.col("s.startTimeUnixNano").cast("bigint").alias("ts_ns"),
        F.col("s.endTimeUnixNano").cast("bigint").alias("end_ns"),
        F.coalesce(service, unnamed).alias("service_name"),
        _attributes(F.col("s.attributes")).alias("attributes"),
        "scope_name",
    )


# Where the answers of discovery operations list their items, in order of preference.
DISCOVERY_LISTS = {
    "labels": ("$.data",),
    "label_values": ("$.data",),
    "series": ("$.data",),
    "search": ("$.traces",),
    "tags": ("$.tagNames", "$.scopes"),
    "tag_values": ("$.tagValues", "$.values"),
}


def _listed(text: Column) -> Column:
    """The items of a JSON list; texts as they are, objects as JSON. Null for anything else."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def flatten_discovery(responses: DataFrame, body: str, operation: str = "operation") -> DataFrame:
    """A20-A22. Labels, values, series, traces, tags and metadata as one row per item.

    Columns: what `responses` has besides the body, then `name` (the metric of a metadata entry, else
    null), `at` (place in the list, from 0) and `item`. An answer without its list gives no row.
    """
    rest = [c for c in responses.columns if c != body]
    items = F.lit(None).cast("array<string>")
    for kind, places in DISCOVERY_LISTS.items():
        found = F.coalesce(*[_listed(F.get_json_object(body, place)) for place in places])
        items = F.when(F.col(operation) == kind, found).otherwise(items)
    plain = responses.select(*rest, F.lit(None).cast("string").alias("name"), F.posexplode(items).alias("at", "item"))
    described = responses.where(F.col(operation) == "metadata").select(
        *rest, F.explode(F.from_json(F.get_json_object(body, "$.data"), "map<string,string>")).alias("name", "entries"))
    entries = described.select(*rest, "name", F.posexplode(_listed(F.col("entries"))).alias("at", "item"))
    return plain.unionByName(entries)


def series_labels(item: Column) -> Column:
    """The label map of a series item."""
    return F.from_json(item, "map<string,string>")
