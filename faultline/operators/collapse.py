"""Collapse of repeated observations and the audits around it (D, B5, B10, B19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.functions.skew import running_max
from faultline.session import work_dir


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def fold_collisions(names: DataFrame, source: str, folded: Column) -> DataFrame:
    """B5. Folded names that more than one source name maps to."""
    # Distinct pairs first: a hot metric name shrinks to one row per map task.
    pairs = names.select(F.col(source).alias("source"), folded.alias("folded")).distinct()
    return (
        pairs.groupBy("folded")
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.min("source").alias("first_source"),
            F.max("source").alias("last_source"),
        )
        .where("sources > 1")
    )


def require_no_collision(names: DataFrame, source: str, folded: Column) -> DataFrame:
    """B5 as a check: the result is empty, or the job ends with the two names."""
    clash = fold_collisions(names, source, folded)
    message = F.concat_ws(
        ", ", F.lit("name collision after folding"), "first_source", "last_source"
    )
    return clash.withColumn("folded", F.raise_error(message).cast("string"))


def without_collisions(samples: DataFrame, source: str = "source_name", folded: str = "metric") -> DataFrame:
    """B5. The samples, unless two source names fold to one: then the job ends, as two series would
    become one.

    The samples are written once to the work folder, and the pass that writes them observes their
    distinct names: the driver gets the names of an archive's metrics, never samples.
    """
    seen = Observation("names")
    path = work_dir(samples.sparkSession, "samples")
    pairs = F.collect_set(F.struct(F.col(folded).alias("folded"), F.col(source).alias("source")))
    samples.observe(seen, pairs.alias("pairs")).write.option("compression", "zstd").parquet(path)
    first: dict[str, str] = {}
    for name, original in sorted((r["folded"], r["source"]) for r in seen.get["pairs"]):
        if first.setdefault(name, original) != original:
            raise ValueError(f"name collision after folding, {first[name]}, {original}")
    return samples.sparkSession.read.schema(samples.schema).parquet(path)


def histogram_samples(points: DataFrame) -> DataFrame:
    """B10. One histogram point becomes count, optional sum and one open bucket sample."""
    labels = F.col("labels")
    parts = F.array(
        F.struct(
            F.concat("metric", F.lit("_count")).alias("metric"),
            F.col("count").cast("double").alias("value"),
            labels.alias("labels"),
            F.lit(0).alias("part"),
        ),
        F.struct(
            F.concat("metric", F.lit("_sum")).alias("metric"),
            F.col("sum").cast("double").alias("value"),
            labels.alias("labels"),
            F.lit(1).alias("part"),
        ),
        F.struct(
            F.concat("metric", F.lit("_bucket")).alias("metric"),
            F.col("count").cast("double").alias("value"),
            F.map_concat(labels, F.create_map(F.lit("le"), F.lit("inf"))).alias("labels"),
            F.lit(2).alias("part"),
        ),
    )
    kept = F.filter(parts, lambda p: (p["part"] != 1) | p["value"].isNotNull())
    rest = [c for c in points.columns if c not in ("metric", "count", "sum", "min", "max", "labels")]
    return points.select(*_cols(rest), F.explode(kept).alias("p")).select(*_cols(rest), "p.*")


def union_sources(*sources: DataFrame) -> DataFrame:
    """I9. Rows of several sources or periods; a column only one of them has is null elsewhere."""
    merged = sources[0]
    for source in sources[1:]:
        merged = merged.unionByName(source, allowMissingColumns=True)
    return merged


def last_observation(
    samples: DataFrame, keys: list[str], value: str, order: list[str]
) -> DataFrame:
    """D1. One row per key: the value that came last in source order.

    `order` names the columns that define the source order; Spark has no order
    of its own. All aggregates combine before the shuffle, so a hot key is one
    row per map task.
    """
    rank = F.struct(*_cols(order)) if len(order) > 1 else F.col(order[0])
    return samples.groupBy(*keys).agg(
        F.max_by(value, rank).alias(value),
        F.count(F.lit(1)).alias("observations"),
        (F.min(value) < F.max(value)).alias("ambiguous"),
    )


def collapse_audit(collapsed: DataFrame) -> DataFrame:
    """D1. Counts around a collapse: observations, kept, repeated, ambiguous."""
    return collapsed.agg(
        F.coalesce(F.sum("observations"), F.lit(0)).alias("source_observations"),
        F.count(F.lit(1)).alias("kept_samples"),
        F.coalesce(F.sum(F.col("observations") - 1), F.lit(0)).alias("repeated_observations"),
        F.count_if("ambiguous").alias("ambiguous_identities"),
        F.coalesce(F.sum(F.when(F.col("ambiguous"), F.col("observations"))), F.lit(0)).alias(
            "ambiguous_observations"
        ),
    )


def sample_audit(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """D2. Source rows, valid, unique, duplicate and conflicting samples."""
    valid = N.is_finite(value)
    per_key = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid).alias("valid"),
        F.min(F.when(valid, F.col(value))).alias("low"),
        F.max(F.when(valid, F.col(value))).alias("high"),
    )
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_samples"),
        F.count_if(F.col("valid") > 0).alias("unique_samples"),
        (F.coalesce(F.sum("valid"), F.lit(0)) - F.count_if(F.col("valid") > 0)).alias(
            "duplicate_samples"
        ),
        F.count_if(F.col("low") < F.col("high")).alias("conflicting_timestamps"),
    )


def protocol_rows(numbers: DataFrame, histograms: DataFrame, keys: list[str]) -> DataFrame:
    """D3. Distinct keys a store holds after the histogram fan-out."""
    fanned = histogram_samples(histograms).select(*_cols(keys))
    return (
        numbers.select(*_cols(keys))
        .unionByName(fanned)
        .distinct()
        .agg(F.count(F.lit(1)).alias("protocol_rows"))
    )


def kind_collisions(points: DataFrame, name: str, kind: str) -> DataFrame:
    """D4. Metric names seen under more than one kind."""
    return (
        points.select(name, kind)
        .distinct()
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
    )


def presence_and_multiplicity(source: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """D5. Per distinct record: copies in the source and in a store that may collapse them."""
    left = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_copies"))
    right = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored_copies"))
    merged = left.join(right, keys, "full_outer").na.fill(0, ["source_copies", "stored_copies"])
    return merged.select(
        *keys,
        "source_copies",
        "stored_copies",
        ((F.col("source_copies") > 0) & (F.col("stored_copies") == 0)).alias("missing"),
        F.greatest(F.col("stored_copies") - F.col("source_copies"), F.lit(0)).alias("extra"),
    )


def repeated_calls(calls: DataFrame, run: str, identity: list[str]) -> DataFrame:
    """D6. Calls of a run beyond the first with the same tool and arguments."""
    return (
        calls.groupBy(run, *identity)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(run)
        .agg(F.sum(F.col("n") - 1).alias("exact_repeated_calls"))
    )


def identity_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """D8. Whether a key identifies one row."""
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("identities"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("unique"),
    )


def first_appearance(rows: DataFrame, keys: list[str], ident: str, ordinal: str) -> DataFrame:
    """D9. Distinct ids with the ordinal of their first appearance."""
    return rows.groupBy(*keys, ident).agg(F.min(ordinal).alias("first_ordinal"))


def label_order(samples: DataFrame, labels: str, order: str) -> DataFrame:
    """B19. Label names by their first appearance: the row in `order`, then the place in the map."""
    keys = samples.select(F.posexplode(F.map_keys(labels)).alias("at", "label"), F.col(order).alias("row"))
    return keys.groupBy("label").agg(F.min(F.struct("row", "at")).alias("first")).select(
        "label", F.col("first.row").alias("row"), F.col("first.at").alias("at"))


def spread_labels(
    samples: DataFrame, labels: str, names: list[str]
) -> DataFrame:
    """B19. Label map to columns, one row per sample.

    The labels in `names` keep their names and come first; a sample column of the same name gets
    a trailing `_`. The names are the schema of the result, so the caller states them;
    `label_order` lists what a source has.
    """
    taken = set(names)
    rest = []
    for column in samples.columns:
        if column == labels:
            continue
        shown = column
        while shown in taken:
            shown += "_"
        taken.add(shown)
        rest.append(F.col(column).alias(shown))
    return samples.select(*[F.col(labels)[n].alias(n) for n in names], *rest)


def duplicate_incidents(
    cases: DataFrame, node: str, case: str, start: str, end: str, bucket_width: int = 86_400
) -> DataFrame:
    """D7. Marks a case whose window overlaps an earlier kept case of the same node.

    Cases are taken in case order and a rejected one does not block later ones,
    so the outcome is sequential inside a chain of overlapping windows, and
    chains are independent. A chain begins where no earlier window is open;
    the running maxima which find these points work per time bucket, so a hot
    node is spread over its buckets. Chains are then streamed in case order
    with the kept windows as the only state.
    """
    columns = cases.columns
    timed = cases.withColumn("_bucket", W.floor_div(start, bucket_width))
    order = [start, end, case]
    opened = running_max(timed, [node], "_bucket", order, end, "_open_until", inclusive=False)
    opens = F.when(
        F.col("_open_until").isNull() | (F.col(start) >= F.col("_open_until")), F.col(start)
    )
    marked = opened.withColumn("_opens", opens).drop("_open_until")
    chains = running_max(marked, [node], "_bucket", order, "_opens", "_chain").drop(
        "_bucket", "_opens"
    )
    schema = chains.select(*columns).schema.add("duplicate", "boolean")

    def resolve(batches):
        import bisect

        current, starts, ends = None, [], []
        for pdf in batches:
            flags = []
            for owner, chain, s, e in zip(pdf[node], pdf["_chain"], pdf[start], pdf[end]):
                if (owner, chain) != current:
                    current, starts, ends = (owner, chain), [], []
                # Kept windows never overlap, so both lists are sorted together
                # and only the neighbours of the insertion point can collide.
                at = bisect.bisect_left(starts, s)
                hit = s < e and (
                    (at > 0 and ends[at - 1] > s) or (at < len(starts) and starts[at] < e)
                )
                flags.append(bool(hit))
                if not hit and s < e:
                    starts.insert(at, s)
                    ends.insert(at, e)
            yield pdf[columns].assign(duplicate=flags)

    return (
        chains.repartition(node, "_chain")
        .sortWithinPartitions(node, "_chain", case)
        .mapInPandas(resolve, schema)
    )
