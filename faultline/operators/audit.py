"""Fidelity audits: periods, identities, multiset and edge-set equality, digests, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.operators.callgraph import EDGE


def table_stats(rows: DataFrame, table: str, ts: str) -> DataFrame:
    """F13. Rows and time range of every table in one grouped pass."""
    return rows.groupBy(table).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("min_time"),
        F.max(ts).alias("max_time"),
    )


def group_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """F14. Rows per value of several dimensions.

    The rows fold to distinct combinations first, then every dimension is
    counted on the folded rows.
    """
    folded = rows.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    return (
        folded.select("n", F.explode(parts).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.sum("n").alias("row_count"))
    )


def _span_valid(allow_zero: bool, kinds: int, statuses: int) -> Column:
    parent = F.coalesce("parent_span_id", F.lit(""))
    return (
        N.valid_hex_id("trace_id", 16, allow_zero)
        & N.valid_hex_id("span_id", 8, allow_zero)
        & ((parent == "") | N.valid_hex_id(parent, 8, allow_zero))
        & (F.coalesce("service_name", F.lit("")) != "")
        & F.coalesce(F.col("kind").between(0, kinds - 1), F.lit(False))
        & F.coalesce(F.col("status").between(0, statuses - 1), F.lit(False))
    )


def trace_identity(
    spans: DataFrame, allow_zero: bool = False, kinds: int = 6, statuses: int = 3, by: tuple[str, ...] = ()
) -> DataFrame:
    """F15. Whether span identities are unique and every id, enum and service is valid.

    `by` names columns that part the spans into copies; all copies are audited in one pass.
    """
    per_id = spans.groupBy(*by, "trace_id", "span_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~_span_valid(allow_zero, kinds, statuses)).alias("bad")
    )
    totals = per_id.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("spans"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("span_identity_unique"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_spans"),
    )
    return totals.withColumn(
        "valid", F.col("span_identity_unique") & (F.col("invalid_spans") == 0)
    )


def signal_periods(rows: DataFrame, keys: list[str], ts: str, start, end) -> DataFrame:
    """F16. Rows outside of a half-open window; a row exactly at the end is a failure."""
    t, s, e = F.col(ts), W._c(start), W._c(end)
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(t < s).alias("rows_before_start"),
        F.count_if(t == e).alias("rows_at_exact_end"),
        F.count_if(t > e).alias("rows_after_end"),
        F.count_if(t.isNull()).alias("null_timestamps"),
    )
    outside = ("rows_before_start", "rows_at_exact_end", "rows_after_end", "null_timestamps")
    clean = F.lit(True)
    for name in outside:
        clean = clean & (F.col(name) == 0)
    return counted.withColumn("all_rows_in_declared_window", clean)


def observed_window(rows: DataFrame, keys: list[str], ts: str, start, end) -> DataFrame:
    """F17. Observed time range and whether it lies inside of the declared window."""
    seen = rows.groupBy(*keys).agg(F.min(ts).alias("minimum"), F.max(ts).alias("maximum"))
    inside = (F.col("minimum") >= W._c(start)) & (F.col("maximum") < W._c(end))
    return seen.withColumn("in_window", F.coalesce(inside, F.lit(False)))


def window_rows(rows: DataFrame, file: str, ts: str, start: int, end: int, scale: Column):
    """F18. Rows per file inside of a closed window; `scale` is the file's units per second."""
    inside = F.col(ts).between(F.lit(start) * scale, F.lit(end) * scale)
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(inside).alias("window_rows")
    )


def metric_stream(points: DataFrame, keys: list[str], ts_s: str, start: int, end: int) -> DataFrame:
    """F19. The metric stream before any filter: rows, invalid values, unique samples.

    Distinct samples are found by grouping on the sample key, so no task holds
    a whole metric; the names follow from the grouped rows.
    """
    inside = W.half_open(ts_s, start, end)
    valid = N.is_finite("value")
    grouped = points.groupBy("metric", *keys).agg(
        F.count_if(inside).alias("rows"),
        F.count_if(inside & ~valid).alias("invalid"),
        F.bool_or(inside & valid).alias("sample"),
        F.count_if(F.col(ts_s) == end).alias("at_end"),
    )
    per_metric = grouped.groupBy("metric").agg(
        F.sum("rows").alias("rows"),
        F.sum("invalid").alias("invalid"),
        F.count_if("sample").alias("unique_samples"),
        F.sum("at_end").alias("at_end"),
    )
    return per_metric.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in_window"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_values"),
        F.coalesce(F.sum("unique_samples"), F.lit(0)).alias("unique_samples"),
        F.coalesce(F.sum("at_end"), F.lit(0)).alias("rows_at_exact_end"),
        F.count_if(F.col("unique_samples") > 0).alias("metric_tables"),
    )


def scope_declarations(catalog: DataFrame, keys: list[str], declarations: str) -> DataFrame:
    """F84. Declared entities with a scope per key; a malformed document makes the count null."""
    items = F.try_variant_get(F.try_parse_json(declarations), "$", "array<variant>")
    scoped = F.size(
        F.filter(
            items, lambda d: F.coalesce(F.try_variant_get(d, "$.scope", "string"), F.lit("")) != ""
        )
    )
    declared = F.col(declarations).isNotNull()
    read = catalog.select(
        *keys, declared.alias("_d"), F.when(declared & items.isNotNull(), scoped).alias("_n")
    )
    return read.groupBy(*keys).agg(
        F.when(F.count("_n") == F.count_if("_d"), F.coalesce(F.sum("_n"), F.lit(0))).alias(
            "scope_declaration_count"
        )
    )


def _undeclared(service: str) -> Column:
    return F.coalesce(service, F.lit("")).isin("", "unknown")


def declared_services(spans: DataFrame, service: str) -> DataFrame:
    """F85. No span without a source-declared service name."""
    return spans.agg(F.coalesce(F.bool_and(~_undeclared(service)), F.lit(True)).alias("service_names_declared"))


def first_alert(alerts: DataFrame, case: str, ts: str) -> DataFrame:
    """F86. First alert time per case."""
    return alerts.groupBy(case).agg(F.min(ts).cast("bigint").alias("first_alert"))


def fault_taxonomy(manifest: DataFrame, system: str, kind: str) -> DataFrame:
    """F86. Distinct fault kinds of the single-fault cases per system, one row per kind."""
    usable = ~F.col("hybrid") & F.col(kind).isNotNull() & (F.col(kind) != "")
    return manifest.where(usable).select(system, kind).distinct()


def alert_text(issues: DataFrame, case: str, system: str, payload: str) -> DataFrame:
    """F86. One line per case from the distinct keys of its alert objects, sorted.

    The keys are made distinct before they are gathered, so what reaches a task
    is the list of alert names and not the alerts.
    """
    keys = issues.select(
        case, system, F.explode(F.json_object_keys(payload)).alias("issue")
    ).distinct()
    return keys.groupBy(case, system).agg(
        F.concat(
            F.col(system), F.lit(" alert: "),
            F.array_join(F.array_sort(F.collect_list("issue")), ", "),
        ).alias("alert_text")
    )


def topology_size(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """F87. Entities, edges and calls of a source topology."""
    zero = F.lit(0).cast("bigint")
    return (
        entities.agg(F.count(F.lit(1)).alias("entities"), zero.alias("edges"), zero.alias("calls"))
        .unionByName(
            edges.agg(
                zero.alias("entities"),
                F.count(F.lit(1)).alias("edges"),
                F.count_if(F.col("relation") == "calls").alias("calls"),
            )
        )
        .agg(*[F.sum(c).alias(c) for c in ("entities", "edges", "calls")])
    )


#: Hash buckets of an audit. Their digests are what one driver may hold: numbers, not records.
RECORD_BUCKETS = 1024
BUCKET = "record_bucket"
_DIGEST = ("d0", "d1", "d2", "d3")


def _hashes(keys: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a record. Null differs from every value, and its place counts."""
    parts = [part for k in keys for part in (F.col(k).isNull(), F.col(k))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def record_bucket(keys: list[str], buckets: int = RECORD_BUCKETS) -> Column:
    return F.pmod(_hashes(keys)[0], F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, keys: list[str], buckets: int = RECORD_BUCKETS) -> DataFrame:
    """Rows and a digest of 128 bits per hash bucket, in any order of rows.

    Digests are sums of halves of two hashes, so that equal records count as often as they occur.
    """
    low, mask = _hashes(keys), F.lit((1 << 32) - 1)
    halves = [h for x in low for h in (x.bitwiseAND(mask), F.shiftrightunsigned(x, 32))]
    hashed = rows.select(record_bucket(keys, buckets).alias(BUCKET), *[h.alias(d) for h, d in zip(halves, _DIGEST)])
    return hashed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(d).alias(d) for d in _DIGEST])


def compared_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets of either side with the rows of both, and whether their digests differ."""
    sides = left.select("*", F.lit(1).alias("_l")).unionByName(right.select("*", F.lit(0).alias("_l")))
    mine = F.col("_l") == 1
    same = [F.coalesce(F.sum(F.when(mine, F.col(c)).otherwise(-F.col(c))), F.lit(0)) == 0 for c in ("rows", *_DIGEST)]
    equal = same[0]
    for one in same[1:]:
        equal = equal & one
    return sides.groupBy(BUCKET).agg(
        F.coalesce(F.sum(F.when(mine, F.col("rows"))), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(~mine, F.col("rows"))), F.lit(0)).alias("right_rows"),
        (~equal).alias("changed"),
    )


def changed_buckets(left: DataFrame, right: DataFrame) -> list[int]:
    """The buckets to open, at most as many numbers as there are buckets."""
    return sorted(r[0] for r in compared_buckets(left, right).where("changed").select(BUCKET).collect())


def _alike(source: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the types of their union: a hash depends on the type."""
    kinds = source.select(*keys).unionByName(stored.select(*keys)).schema
    return tuple(d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]) for d in (source, stored))


def _audited(
    source: DataFrame, stored: DataFrame, keys: list[str], buckets: int
) -> tuple[int, int, DataFrame, DataFrame]:
    """Rows of both sides, and the records of both in buckets that differ.

    The driver gets one row of numbers per bucket.
    """
    left, right = _alike(source, stored, keys)
    compared = compared_buckets(bucket_digests(left, keys, buckets), bucket_digests(right, keys, buckets)).collect()
    changed = [r[BUCKET] for r in compared if r["changed"]]
    in_changed = record_bucket(keys, buckets).isin(changed)
    sizes = (sum(r["left_rows"] for r in compared), sum(r["right_rows"] for r in compared))
    return *sizes, left.where(in_changed), right.where(in_changed)


def record_copies(source: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Copies of every distinct row on both sides, from one shuffle of folded rows."""
    left = source.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    right = stored.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    return (
        left.unionByName(right)
        .groupBy(*keys)
        .agg(F.sum("_l").alias("source_copies"), F.sum("_r").alias("stored_copies"))
    )


def multiset_difference(
    source: DataFrame, stored: DataFrame, keys: list[str], buckets: int = RECORD_BUCKETS
) -> DataFrame:
    """I1. Rows missing from and added to a stored copy, counted with multiplicity.

    Digests of hash buckets are compared first; only records in buckets that differ are shuffled.
    """
    source_rows, stored_rows, left, right = _audited(source, stored, keys, buckets)
    gap = F.col("source_copies") - F.col("stored_copies")
    return (
        record_copies(left, right, keys)
        .agg(
            F.lit(source_rows).cast("long").alias("source_rows"),
            F.lit(stored_rows).cast("long").alias("stored_rows"),
            F.coalesce(F.sum(F.greatest(gap, F.lit(0))), F.lit(0)).alias("missing_rows"),
            F.coalesce(F.sum(F.greatest(-gap, F.lit(0))), F.lit(0)).alias("extra_rows"),
        )
        .withColumn("equal", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0))
    )


def presence_difference(source: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """I2. For stores that collapse identical records: distinct presence, extras by multiplicity.

    A collapsed copy differs in the bucket of every repeated record, and distinct records must be
    counted in all buckets, so records are compared by 128 bits of hashes: 16 bytes of each are
    shuffled instead of all columns.
    """
    left, right = _alike(source, stored, keys)
    hashed = left.select(*[h.alias(n) for h, n in zip(_hashes(keys), ("h", "g"))], F.lit(1).alias("_l")).unionByName(
        right.select(*[h.alias(n) for h, n in zip(_hashes(keys), ("h", "g"))], F.lit(0).alias("_l"))
    )
    copies = hashed.groupBy("h", "g").agg(
        F.sum("_l").alias("source_copies"), F.sum(1 - F.col("_l")).alias("stored_copies")
    )
    present = F.col("source_copies") > 0
    extra = F.greatest(F.col("stored_copies") - F.col("source_copies"), F.lit(0))
    lost = present & (F.col("stored_copies") == 0)
    return (
        copies.agg(
            F.coalesce(F.sum("source_copies"), F.lit(0)).alias("source_records"),
            F.coalesce(F.sum("stored_copies"), F.lit(0)).alias("stored_records"),
            F.count_if(present).alias("distinct_source_records"),
            F.count_if(lost).alias("missing_records"),
            F.coalesce(F.sum(extra), F.lit(0)).alias("extra_records"),
        )
        .withColumn(
            "source_duplicate_records", F.col("source_records") - F.col("distinct_source_records")
        )
        .withColumn("equal", (F.col("missing_records") == 0) & (F.col("extra_records") == 0))
    )


def difference_examples(
    source: DataFrame, stored: DataFrame, keys: list[str], examples: int = 3, buckets: int = RECORD_BUCKETS
) -> DataFrame:
    """I2. The first missing and the first extra records, in key order, from buckets that differ."""
    _, _, left, right = _audited(source, stored, keys, buckets)
    copies = record_copies(left, right, keys)
    order = [F.col(k).asc() for k in keys]

    def first(condition: Column, kind: str) -> DataFrame:
        rows = copies.where(condition).select(F.lit(kind).alias("kind"), *keys)
        return rows.orderBy(*order).limit(examples)

    missing = (F.col("source_copies") > 0) & (F.col("stored_copies") == 0)
    extra = F.col("stored_copies") > F.col("source_copies")
    return first(missing, "missing").unionByName(first(extra, "extra"))


EDGE_FACTS = [*EDGE, "request_count", "error_count"]


def edge_sets_equal(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | None = None,
    left_truncated: bool = False,
    right_truncated: bool = False,
) -> DataFrame:
    """I3/I4. Complete edge sets with counts, per `keys` (such as the period).

    An empty or truncated side, a null count or a repeated identity makes the
    sets not comparable (null).
    """
    keys = keys or []
    both = left.select(*keys, *EDGE_FACTS, F.lit("l").alias("_side")).unionByName(
        right.select(*keys, *EDGE_FACTS, F.lit("r").alias("_side"))
    )
    per_edge = both.groupBy(*keys, *EDGE).agg(
        *[F.count_if(F.col("_side") == s).alias(f"_{s}") for s in "lr"],
        *[
            F.max(F.when(F.col("_side") == s, F.col(m))).alias(f"_{s}_{m}")
            for s in "lr"
            for m in ("request_count", "error_count")
        ],
        F.bool_or(F.col("request_count").isNull() | F.col("error_count").isNull()).alias("_null"),
    )
    same = (
        (F.col("_l") == 1)
        & (F.col("_r") == 1)
        & F.col("_l_request_count").eqNullSafe(F.col("_r_request_count"))
        & F.col("_l_error_count").eqNullSafe(F.col("_r_error_count"))
    )
    total = per_edge.groupBy(*keys).agg(
        F.sum("_l").alias("left_edges"),
        F.sum("_r").alias("right_edges"),
        F.bool_or((F.col("_l") > 1) | (F.col("_r") > 1) | F.col("_null")).alias("_broken"),
        F.bool_and(same).alias("_same"),
    )
    comparable = ~(
        F.coalesce(F.col("_broken"), F.lit(False))
        | (F.coalesce(F.col("left_edges"), F.lit(0)) == 0)
        | (F.coalesce(F.col("right_edges"), F.lit(0)) == 0)
        | F.lit(left_truncated or right_truncated)
    )
    return total.select(
        *keys,
        F.coalesce("left_edges", F.lit(0)).alias("left_edges"),
        F.coalesce("right_edges", F.lit(0)).alias("right_edges"),
        F.when(comparable, F.col("_same")).alias("exact"),
    )


# Suffixes of the tables one histogram is stored as.
HISTOGRAM_SUFFIXES = ("_bucket", "_count", "_sum")


def unexpected_tables(
    stored: DataFrame, numbers: DataFrame, histograms: DataFrame, fixed: list[str]
) -> DataFrame:
    """I5. Stored tables the source metric names do not explain."""
    plain = numbers.select(N.fold_metric_name("metric").alias("table_name"))
    fanned = histograms.select(
        F.explode(
            F.array(
                *[F.concat(N.fold_metric_name("metric"), F.lit(s)) for s in HISTOGRAM_SUFFIXES]
            )
        ).alias("table_name")
    )
    expected = plain.unionByName(fanned).distinct()
    return (
        stored.select("table_name")
        .distinct()
        .where(~F.col("table_name").isin(*fixed))
        .join(expected, "table_name", "left_anti")
    )


def reachability(
    returned: DataFrame, expected: DataFrame, causal: DataFrame, ident: str
) -> DataFrame:
    """I6. Search results stay inside of the expected ids and hit at least one causal id."""
    tagged = (
        returned.select(ident, F.lit("r").alias("_side"))
        .unionByName(expected.select(ident, F.lit("e").alias("_side")))
        .unionByName(causal.select(ident, F.lit("c").alias("_side")))
    )
    sides = tagged.groupBy(ident).agg(
        *[F.bool_or(F.col("_side") == s).alias(f"_{s}") for s in "rec"]
    )
    counted = sides.agg(
        F.count_if("_r").alias("returned"),
        F.count_if(F.col("_r") & F.col("_c")).alias("returned_causal"),
        F.count_if(F.col("_r") & ~F.col("_e")).alias("returned_outside"),
    )
    return counted.withColumn(
        "reachable", (F.col("returned_causal") > 0) & (F.col("returned_outside") == 0)
    )


def generated_labels(stored: DataFrame, source: DataFrame, labels: str) -> DataFrame:
    """I7. Label names only the store has, with the entries that carry them."""
    ours = (
        source.select(F.explode(F.map_keys(labels)).alias("k"))
        .distinct()
        .select(N.fold_label_name("k").alias("label"))
        .distinct()
    )
    return (
        stored.select(F.explode(F.map_keys(labels)).alias("label"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("entries"))
        .join(ours, "label", "left_anti")
    )


def foreign_streams(stored: DataFrame, asked: str, carrier: Column) -> DataFrame:
    """I7. Streams that answered a query for another table."""
    return stored.select(asked, carrier.alias("_table")).groupBy(asked).agg(
        F.count_if(~F.col("_table").eqNullSafe(F.col(asked))).alias("streams_from_another_table")
    )


def canonical_double(value: Column | str) -> Column:
    """I8. One text per number: no negative zero, one NaN."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.isnan(v), "nan").when(v == 0, "0.0").otherwise(v.cast("string"))


def dataset_digest(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """I8. Order-independent digest: row count and the sum of 60 bits of every row's sha256.

    A sum keeps multiplicity and combines before the shuffle, so the digest of
    any number of rows is one row per task.
    """
    chosen = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    plain = [
        canonical_double(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string")
        for f in chosen.schema.fields
    ]
    text = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in plain])
    # 60 bits are 19 digits: the sum of 10^19 rows fits.
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return chosen.select(part.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"),
    )


def gate_table(gates: dict[str, DataFrame], shared: list[DataFrame] | None = None) -> DataFrame:
    """I10. Named one-row booleans as rows, with `all_passed` at the end.

    Every value is the only boolean column of a one-row frame; null is a failure. `shared` are
    tables of gates already, each from one aggregate (`shared_gates`).
    """
    table = None
    for rows in shared or []:
        table = rows if table is None else table.unionByName(rows)
    for name, frame in gates.items():
        column = next(f.name for f in frame.schema.fields if f.dataType.typeName() == "boolean")
        row = frame.agg(F.coalesce(F.bool_and(column), F.lit(False)).alias("passed")).select(
            F.lit(name).alias("gate"), "passed"
        )
        table = row if table is None else table.unionByName(row)
    # The grand total of the same aggregate, so that no gate is computed twice.
    return table.rollup("gate").agg(F.bool_and("passed").alias("passed")).select(
        F.coalesce("gate", F.lit("all_passed")).alias("gate"), "passed"
    )


def shared_gates(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """I10. Gates on one table as (gate, passed), from one aggregate over it.

    Every gate is a boolean aggregate; null is a failure.
    """
    one = rows.agg(*[F.coalesce(g, F.lit(False)).alias(name) for name, g in gates.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("gate"), F.col(name).alias("passed")) for name in gates
    ])).alias("g")).select("g.*")


def span_gates(spans: DataFrame, allow_zero: bool = False, kinds: int = 6, statuses: int = 3) -> DataFrame:
    """F15, F85 and B14 as gates on one table of spans, from one fold by their identity."""
    short = ~(N.valid_hex_id("trace_id", 16) & N.valid_hex_id("span_id", 8))
    per_id = spans.groupBy("trace_id", "span_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~_span_valid(allow_zero, kinds, statuses)).alias("bad"),
        F.count_if(_undeclared("service_name")).alias("unnamed"), F.count_if(short).alias("short"),
    )
    none = {c: F.coalesce(F.sum(c), F.lit(0)) == 0 for c in ("bad", "unnamed", "short")}
    unique = F.coalesce(F.max("n") == 1, F.lit(True))
    return shared_gates(per_id, {
        "spans_unique": unique, "source_trace_identity_valid": unique & none["bad"],
        "service_names_declared": none["unnamed"], "ids_fit_the_protocol": none["short"],
    })


def count_agreement(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """I13. Expected against stored counts per key; a key of one side only disagrees."""
    return (
        expected.select(*keys, F.col("row_count").alias("expected_rows"))
        .join(stored.select(*keys, F.col("row_count").alias("stored_rows")), keys, "full_outer")
        .na.fill(0, ["expected_rows", "stored_rows"])
        .withColumn("match", F.col("expected_rows") == F.col("stored_rows"))
    )


def id_remapping(spans: DataFrame, column: str, size: int) -> DataFrame:
    """B14. Distinct ids that need a surrogate of the protocol's size."""
    bad = spans.where(~N.valid_hex_id(column, size)).select(column).distinct()
    return bad.agg(F.count(F.lit(1)).alias("remapped"))
