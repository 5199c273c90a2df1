"""Column expressions that bring source telemetry into canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.windows import floor_div

NANOS_PER_SECOND = 1_000_000_000

# Span kinds and status codes of the tracing data model.
SPAN_KINDS = {
    "Unspecified": 0,
    "Internal": 1,
    "Server": 2,
    "Client": 3,
    "Producer": 4,
    "Consumer": 5,
}
STATUS_CODES = {"Unset": 0, "Ok": 1, "Error": 2}

# Ordered keyword rules, first hit wins.
CATEGORY_RULES = {
    "reason": (
        ("memory", ("memory",)),
        ("cpu", ("cpu",)),
        ("disk", ("i/o", "disk")),
        ("delay", ("latency", "delay", "response time")),
        ("loss", ("loss",)),
    ),
    "kind": (
        ("delay", ("delay", "latency", "time")),
        ("loss", ("loss", "abort", "disconnect")),
        ("cpu", ("cpu",)),
        ("memory", ("memory", "oom", "gc")),
        ("disk", ("disk", "io")),
    ),
    "node": (
        ("cpu", ("cpu",)),
        ("memory", ("memory", "oom", "gc")),
        ("disk", ("disk", "iohigh")),
        ("delay", ("latency",)),
    ),
}
# Node fault names that mean delay without naming it.
NODE_DELAY_NAMES = ("slowsql", "slowresource")

# Words that may follow a component name in an answer.
QUALIFIERS = "(service|pod|container|instance|deployment)+"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_nanoseconds(timestamp: Column | str) -> Column:
    """B1. Epoch value of unknown unit to nanoseconds, by magnitude."""
    t = _c(timestamp).cast("bigint")
    size = F.abs(t)
    return (
        F.when(size < F.lit(10**11), t * F.lit(10**9))
        .when(size < F.lit(10**14), t * F.lit(10**6))
        .when(size < F.lit(10**17), t * F.lit(10**3))
        .otherwise(t)
    )


_ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?$"


def iso_to_nanoseconds(text: Column | str, strict: bool = True) -> Column:
    """B2. ISO-8601 with offset to epoch nanoseconds, all nine digits kept.

    Integer arithmetic only: a double would lose the last three digits.
    """
    t = _c(text)
    parts = F.array(*[F.regexp_extract(t, _ISO, group) for group in (1, 2, 3)])

    def value(part: Column) -> Column:
        base, fraction, zone = (F.get(part, F.lit(i)) for i in range(3))
        digits = F.regexp_replace(zone, "[^0-9]", "")
        offset = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(
            F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
            * (
                F.substring(digits, 1, 2).try_cast("int") * 3600
                + F.substring(digits, 3, 2).try_cast("int") * 60
            )
        )
        local = F.unix_seconds(
            F.try_to_timestamp(F.concat(base, F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
        )
        nanos = F.rpad(fraction, 9, "0").try_cast("bigint")
        return (local - offset) * F.lit(NANOS_PER_SECOND) + nanos

    # The lambda names the parts, so that each is extracted once. No match leaves an empty date.
    parsed = F.get(F.transform(F.array(parts), value), F.lit(0))
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("invalid ISO timestamp: "), t)).cast("bigint")
    return F.coalesce(parsed, F.when(t.isNotNull(), problem))


def iso_to_seconds(text: Column | str, strict: bool = True) -> Column:
    """B2. Whole epoch seconds, rounded toward minus infinity."""
    return floor_div(iso_to_nanoseconds(text, strict), NANOS_PER_SECOND)


def fold_metric_name(name: Column | str) -> Column:
    """B3. Name restricted to letters, digits, underscore and colon."""
    folded = F.regexp_replace(_c(name), "[^a-zA-Z0-9_:]", "_")
    return F.when(folded.rlike("^[a-zA-Z_:]"), folded).otherwise(
        F.concat(F.lit("metric_"), folded)
    )


def fold_label_name(name: Column | str) -> Column:
    """B4. Label name restricted to letters, digits and underscore."""
    folded = F.regexp_replace(_c(name), "[^a-zA-Z0-9_]", "_")
    return F.when(folded.rlike("^[a-zA-Z_]"), folded).otherwise(F.concat(F.lit("label_"), folded))


def attribute_map(columns: list[str], prefix: str = "attr.", excluded: tuple = ()) -> Column:
    """B6. `attr.*` columns as a map without null and empty values."""
    pairs = [
        (name[len(prefix):], F.col(f"`{name}`").cast("string"))
        for name in columns
        if name.startswith(prefix) and name[len(prefix):] not in excluded
    ]
    return drop_empty(renamed_labels(pairs))


def renamed_labels(pairs) -> Column:
    """B6. Map of label name to column from (label, column) pairs."""
    pairs = list(pairs)
    if not pairs:
        return F.expr("cast(map() as map<string,string>)")
    return F.map_from_arrays(
        F.array(*[F.lit(label) for label, _ in pairs]),
        F.array(*[_c(value).cast("string") for _, value in pairs]),
    )


def drop_empty(labels: Column | str) -> Column:
    return F.map_filter(_c(labels), lambda _, v: v.isNotNull() & (v != ""))


def service_job(namespace: Column | str, name: Column | str) -> Column:
    """B7. `namespace/name`, or the name alone."""
    n = F.nullif(_c(name), F.lit(""))
    return F.when(n.isNotNull(), F.concat_ws("/", F.nullif(_c(namespace), F.lit("")), n))


def service_identity(resource: Column | str) -> Column:
    """B7. `job` and `instance` labels derived from resource attributes."""
    r = _c(resource)
    return drop_empty(
        F.create_map(
            F.lit("job"),
            service_job(r["service.namespace"], r["service.name"]),
            F.lit("instance"),
            r["service.instance.id"],
        )
    )


def canonical_label_value(value: Column | str, kind: str) -> Column:
    """B8. Attribute value of a known type as its canonical label text."""
    v = _c(value)
    if kind == "boolean":
        return F.when(v, F.lit("true")).when(~v, F.lit("false"))
    if kind in ("double", "float"):
        broken = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        return F.when(
            broken, F.raise_error(F.lit("attribute is not a finite number")).cast("string")
        ).otherwise(v.cast("string"))
    if kind == "map":
        entries = F.array_sort(F.map_entries(v))
        return F.to_json(F.map_from_entries(entries))
    if kind == "array":
        return F.to_json(v)
    return v.cast("string")


def labels_key(labels: Column | str) -> Column:
    """Canonical text of a label map, usable as a grouping key."""
    return F.to_json(F.array_sort(F.map_entries(_c(labels))))


def _code(value: Column, table: dict[str, int], what: str, strict: bool) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    code = F.try_element_at(lookup, value)
    if not strict:
        return code
    problem = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null"))))
    return F.coalesce(code, problem.cast("int"))


def span_kind_code(name: Column | str, strict: bool = True) -> Column:
    """B9."""
    return _code(_c(name), SPAN_KINDS, "span kind", strict)


def status_code(name: Column | str, strict: bool = True) -> Column:
    """B9."""
    return _code(_c(name), STATUS_CODES, "span status", strict)


def span_kind_name(code: Column | str) -> Column:
    """B9. Numeric kind to its protocol name."""
    names = [F.lit(f"SPAN_KIND_{name.upper()}") for name in SPAN_KINDS]
    return F.try_element_at(F.array(*names), _c(code).cast("int") + 1)


def status_name(code: Column | str) -> Column:
    names = [F.lit(f"STATUS_CODE_{name.upper()}") for name in STATUS_CODES]
    return F.try_element_at(F.array(*names), _c(code).cast("int") + 1)


def is_finite(value: Column | str) -> Column:
    """B11."""
    v = _c(value).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_fail(value: Column | str, message: str = "non-finite metric value") -> Column:
    """B11. Nulls pass, other non-finite values end the job."""
    v = _c(value).cast("double")
    return F.when(
        v.isNotNull() & ~is_finite(v), F.raise_error(F.lit(message)).cast("double")
    ).otherwise(v)


def span_end(start: Column | str, duration: Column | str) -> Column:
    """B12. End never lies before the start."""
    s = _c(start).cast("bigint")
    return F.greatest(s + _c(duration).cast("bigint"), s)


def valid_hex_id(value: Column | str, size: int, allow_zero: bool = False) -> Column:
    """B13. Exactly `size` bytes of hexadecimal text, not all zero."""
    v = F.coalesce(_c(value), F.lit(""))
    # Decoding is compiled and much cheaper than a pattern; it gives null for other text.
    shaped = (F.length(v) == 2 * size) & F.unhex(v).isNotNull()
    return shaped if allow_zero else shaped & (F.translate(v, "0", "") != "")


def surrogate_id(value: Column | str, size: int, scope: str) -> Column:
    """B14. Valid ids stay; invalid ones get a deterministic id of the same size."""
    v = _c(value)
    digest = F.substring(F.sha2(F.concat(F.lit(f"{scope}:"), v), 256), 1, 2 * size)
    return F.when(valid_hex_id(v, size), v).otherwise(digest)


def fault_category(text: Column | str, rules: str) -> Column:
    """B15. First matching keyword rule, otherwise `other`."""
    t = F.lower(_c(text))
    result = F.lit("other")
    ordered = list(CATEGORY_RULES[rules])
    if rules == "node":
        result = F.when(t.isin(*NODE_DELAY_NAMES), "delay").otherwise(result)
    for category, words in reversed(ordered):
        hit = F.lit(False)
        for word in words:
            hit = hit | t.contains(word)
        result = F.when(hit, category).otherwise(result)
    return result


def alnum(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")


def component_key(text: Column | str) -> Column:
    """B16. Comparable form of a component name."""
    bare = F.regexp_replace(F.trim(_c(text)), r"\s*\([^)]*\)\s*$", "")
    return F.regexp_replace(alnum(bare), "service$", "")


def component_matches(
    predicted: Column | str, expected: Column | str, identities: Column | None = None
) -> Column:
    """B16. Whether an answer names the expected component or a declared identity of it."""
    p, e = component_key(predicted), component_key(expected)
    tail = F.substr(p, F.length(e) + 1)
    qualified = p.startswith(e) & tail.rlike(f"^{QUALIFIERS}$")
    result = (p == e) | qualified
    if identities is not None:
        keys = F.filter(F.transform(identities, component_key), lambda k: k != "")
        rest = F.regexp_replace(tail, f"^{QUALIFIERS}", "")
        result = (
            result
            | F.array_contains(keys, p)
            | (p.startswith(e) & (rest != tail) & F.array_contains(keys, rest))
        )
    return result


def fault_type_matches(predicted: Column | str, expected: Column | str) -> Column:
    """B17."""
    return alnum(predicted) == alnum(expected)


def category_alias(text: Column | str) -> Column:
    """B17. Native category names, with `mem` meaning memory."""
    native = F.lower(F.trim(_c(text)))
    return F.when(native == "mem", "memory").otherwise(native)


# Correlation ids which travel as per-entry metadata.
CORRELATION_LABELS = ("trace_id", "span_id")


def fold_label_map(labels: Column | str, reserved: str | None = None) -> Column:
    """B4/B18. Folds every key; two keys folding to one, or a reserved key, end the job."""
    m = _c(labels)
    folded = F.transform(F.map_keys(m), fold_label_name)
    clash = F.size(F.array_distinct(folded)) < F.size(folded)
    if reserved:
        clash = clash | F.array_contains(folded, reserved)
    problem = F.raise_error(F.lit("label names collide after folding"))
    keys = F.when(clash, problem.cast("array<string>")).otherwise(folded)
    return F.map_from_arrays(keys, F.map_values(m))


def stream_labels(labels: Column | str, table: Column | str, carrier: str = "log_table") -> Column:
    """B18. Stream labels without correlation ids and empty values, with the table stamped."""
    folded = drop_empty(fold_label_map(labels, carrier))
    kept = F.map_filter(folded, lambda k, _: ~k.isin(*CORRELATION_LABELS))
    return F.map_concat(kept, F.create_map(F.lit(carrier), _c(table)))


def entry_metadata(labels: Column | str) -> Column:
    """B18. The correlation ids of one entry."""
    return F.map_filter(
        drop_empty(fold_label_map(labels)), lambda k, _: k.isin(*CORRELATION_LABELS)
    )


def padded_trace_id(value: Column | str) -> Column:
    """B20. 32 lower-case hex digits, or null."""
    v = F.lower(F.trim(_c(value)))
    return F.when(v.rlike("^[0-9a-f]{1,32}$"), F.lpad(v, 32, "0"))


def locus_shape_valid(scope, component, edge_source, edge_destination) -> Column:
    """B22. A component or a directed edge, never both."""
    has_component = _c(component).isNotNull()
    has_edge = _c(edge_source).isNotNull() & _c(edge_destination).isNotNull()
    no_edge = _c(edge_source).isNull() & _c(edge_destination).isNull()
    return F.when(_c(scope) == "edge", ~has_component & has_edge).otherwise(
        has_component & no_edge
    )


def target_label(component, source, destination, strict: bool = True) -> Column:
    """B24. The component, or `source -> destination`."""
    label = F.coalesce(
        F.nullif(_c(component), F.lit("")),
        F.concat(
            F.nullif(_c(source), F.lit("")), F.lit(" -> "), F.nullif(_c(destination), F.lit(""))
        ),
    )
    if not strict:
        return label
    return F.coalesce(label, F.raise_error(F.lit("case has no target")).cast("string"))


def structured_targets(component: Column | str, payload: Column | str) -> Column:
    """B21. Alternative component names a structured ground truth names beside the label."""
    names = F.transform(
        F.from_json(
            _c(payload),
            "outcome struct<target_entities:array<struct<entity_name:string>>>",
        ).getField("outcome").getField("target_entities"),
        lambda t: t["entity_name"],
    )
    named = F.filter(
        F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")
    )
    return F.array_distinct(F.filter(named, lambda n: alnum(n) != alnum(_c(component))))
