"""Incident evidence: phases, thresholds, transitions and what submitted aggregates prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import normalize as N
from faultline.functions import windows as W
from faultline.functions.skew import same_keys


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (
        value if isinstance(value, Column) else F.lit(value)
    )


def phase_aggregates(
    rows: DataFrame,
    component: str,
    ts: str,
    value: str,
    baseline: tuple[int, int],
    incident: tuple[int, int],
) -> DataFrame:
    """F20. Count, mean and maximum per component and phase, in one scan.

    Both phases appear for every component, an empty one with count 0.
    """
    low, high = min(baseline[0], incident[0]), max(baseline[1], incident[1])
    scanned = rows.where(W.half_open(ts, low, high))
    parts = []
    for name, window in (("baseline", baseline), ("incident", incident)):
        inside = F.when(W.half_open(ts, *window), F.col(value))
        member = F.when(W.half_open(ts, *window), F.lit(1))
        parts += [
            F.count(member).alias(f"{name}_count"),
            F.avg(inside).alias(f"{name}_mean"),
            F.max(inside).alias(f"{name}_max"),
        ]
    wide = scanned.groupBy(component).agg(*parts)
    stacked = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("phase"),
                    F.col(f"{p}_count").alias("sample_count"),
                    F.col(f"{p}_mean").alias("mean_value"),
                    F.col(f"{p}_max").alias("max_value"),
                )
                for p in ("baseline", "incident")
            ]
        )
    )
    return wide.select(component, stacked.alias("p")).select(component, "p.*")


def ratio_predicate(phases: DataFrame, component: str, field: str, ratio: float) -> DataFrame:
    """F21. Incident value at least `ratio` times the baseline value.

    Holds trivially for a baseline at or below zero, as declared in the source.
    """

    def at(phase: str, column: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    pivoted = phases.groupBy(component).agg(
        at("baseline", "sample_count").alias("bn"),
        at("incident", "sample_count").alias("n"),
        at("baseline", field).alias("b"),
        at("incident", field).alias("i"),
    )
    met = (F.col("bn") > 0) & (F.col("n") > 0) & (F.col("i") >= F.lit(ratio) * F.col("b"))
    return pivoted.select(
        component,
        F.col("b").alias("baseline_value"),
        F.col("i").alias("incident_value"),
        F.coalesce(met, F.lit(False)).alias("predicate_match"),
    )


def close(a, b, tolerance: float = 1e-9) -> Column:
    """F22. Relative or absolute closeness; null equals only null."""
    x, y = _c(a), _c(b)
    near = F.abs(x - y) <= F.greatest(
        F.lit(tolerance) * F.greatest(F.abs(x), F.abs(y)), F.lit(tolerance)
    )
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)


def same_phases(left: DataFrame, right: DataFrame, component: str) -> DataFrame:
    """F22. Whether two phase tables agree per component: counts exact, values close."""
    keys = [component, "phase"]
    fields = ["sample_count", "mean_value", "max_value"]
    joined = (
        left.select(*keys, *[F.col(f).alias(f"l_{f}") for f in fields])
        .withColumn("in_left", F.lit(True))
        .join(
            right.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields]).withColumn(
                "in_right", F.lit(True)
            ),
            keys,
            "full_outer",
        )
    )
    same = (
        F.coalesce(F.col("in_left") & F.col("in_right"), F.lit(False))
        & (F.col("l_sample_count") == F.col("r_sample_count"))
        & close("l_mean_value", "r_mean_value")
        & close("l_max_value", "r_max_value")
    )
    return joined.groupBy(component).agg(
        F.bool_and(F.coalesce(same, F.lit(False))).alias("canonical_result_match")
    )


def threshold_facts(
    rows: DataFrame, keys: list[str], period: Column, value: str, threshold, empty_as_zero: bool
) -> DataFrame:
    """F23. Count, minimum, maximum and rows at or above the threshold, per key and period.

    One conditional aggregate serves all keys. Both periods appear; an empty
    one has 0.0 as extremes (`empty_as_zero`, source facts) or null (stored facts).
    """
    tagged = rows.withColumn("_p", period).where("_p is not null")
    v = F.col(value)
    parts = []
    for name in ("normal", "abnormal"):
        here = F.col("_p") == name
        parts += [
            F.count_if(here & v.isNotNull()).alias(f"{name}_count"),
            F.min(F.when(here, v)).alias(f"{name}_min"),
            F.max(F.when(here, v)).alias(f"{name}_max"),
            F.count_if(here & (v >= _c(threshold))).alias(f"{name}_high_count"),
        ]
    wide = tagged.groupBy(*keys).agg(*parts)
    if not empty_as_zero:
        return wide
    zero = {f"{n}_{f}": 0 for n in ("normal", "abnormal") for f in ("min", "max")}
    return wide.na.fill(zero)


def facts_by_period(facts: DataFrame, keys: list[str]) -> DataFrame:
    """F23. Wide facts as one row per key and period."""
    fields = ("count", "min", "max", "high_count")
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("period"), *[F.col(f"{p}_{f}").alias(f"{f}_value") for f in fields]
            )
            for p in ("normal", "abnormal")
        ]
    )
    return facts.select(*keys, F.explode(rows).alias("r")).select(
        *keys,
        "r.period",
        F.col("r.count_value").alias("sample_count"),
        F.col("r.min_value").alias("min_value"),
        F.col("r.max_value").alias("max_value"),
        F.col("r.high_count_value").alias("high_count"),
    )


def transition_proven(minimum: int = 2) -> Column:
    """F24. On wide facts: a clear baseline and enough anomalous observations."""
    return (
        (F.col("normal_count") >= 1)
        & (F.col("abnormal_count") >= minimum)
        & (F.col("normal_high_count") == 0)
        & (F.col("abnormal_high_count") >= minimum)
    )


DELAY_THRESHOLD_NS = 500_000_000


def delay_facts(gaps: DataFrame, threshold_ns: int = DELAY_THRESHOLD_NS) -> DataFrame:
    """F25. Threshold facts of call-path start gaps (E5) per directed edge; empty periods are 0."""
    return threshold_facts(
        gaps, ["src_id", "dst_id"], F.col("period"), "gap_ns", threshold_ns, empty_as_zero=True
    )


def peer_maximum(
    telemetry: DataFrame, cases: DataFrame, start: str = "alert", end: str = "window_end"
) -> DataFrame:
    """F26. Highest value of the same metric on other nodes inside of a case's window, or 0.0.

    Telemetry carries the case it was archived for; `cases` has case_id, metric, node.
    """
    joined = _case_rows(telemetry, cases).where(W.half_open("ts", start, end))
    highest = joined.where(F.col("node") != F.col("target_node")).groupBy("case_id").agg(
        F.max("value").alias("peer")
    )
    return cases.select("case_id").join(highest, "case_id", "left").select(
        "case_id", F.coalesce("peer", F.lit(0.0)).alias("peer_abnormal_max")
    )


def _case_rows(telemetry: DataFrame, cases: DataFrame) -> DataFrame:
    named = cases.withColumnRenamed("node", "target_node")
    return telemetry.where(N.is_finite("value")).join(named, ["case_id", "metric"])


def candidate_profiles(telemetry: DataFrame, cases: DataFrame, minimum: int = 2) -> DataFrame:
    """F27. Signal shape of every candidate case, from one conditional aggregate.

    `cases`: case_id, metric, node, threshold, alert, window_end; the baseline is
    the equally long window before the alert.
    """
    base_start, base_end = W.baseline_window("alert", "window_end")
    own = F.col("node") == F.col("target_node")
    normal = W.half_open("ts", base_start, base_end)
    alert = W.half_open("ts", "alert", "window_end")
    v = F.col("value")
    facts = _case_rows(telemetry, cases).groupBy("case_id").agg(
        F.count_if(own & normal).alias("normal_count"),
        F.max(F.when(own & normal, v)).alias("normal_max"),
        F.count_if(own & normal & (v >= F.col("threshold"))).alias("normal_high_count"),
        F.count_if(own & alert).alias("abnormal_count"),
        F.max(F.when(own & alert, v)).alias("abnormal_max"),
        F.count_if(own & alert & (v >= F.col("threshold"))).alias("abnormal_high_count"),
        F.max(F.when(~own & alert, v)).alias("peer_abnormal_max"),
    )
    return cases.select("case_id", "node").join(facts, "case_id", "left").select(
        "case_id",
        "node",
        F.coalesce("normal_max", F.lit(0.0)).alias("normal_max"),
        F.coalesce("abnormal_max", F.lit(0.0)).alias("abnormal_max"),
        F.coalesce("peer_abnormal_max", F.lit(0.0)).alias("peer_abnormal_max"),
        F.coalesce(transition_proven(minimum), F.lit(False)).alias("oracle_available"),
    )


def identity_domains(points: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """F28. Distinct values of every identity column per metric, one row per value."""
    folded = points.select(key, *columns).distinct()
    return (
        folded.unpivot([key], columns, "column", "value")
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
    )


def scope_predicates(points: DataFrame, key: str, identity: str, scope: str) -> DataFrame:
    """F29. The one scope value an identity is bound to, null when there is none or several."""
    usable = points.where(F.col(scope).isNotNull() & (F.col(scope) != ""))
    return usable.groupBy(key, identity).agg(
        F.when(F.min(scope) == F.max(scope), F.min(scope)).alias("scope_value")
    )


def equivalent_identities(
    points: DataFrame, key: str, identity: str, columns: list[str]
) -> DataFrame:
    """E16. Columns whose one value stands for an identity, in both directions.

    Rows fold to distinct identity combinations before anything is compared.
    """
    folded = points.groupBy(key, identity, *columns).agg(F.count(F.lit(1)).alias("n"))
    long = folded.unpivot([key, identity, "n"], columns, "column", "value")
    filled = F.when(F.col("value") != "", F.col("value"))
    forward = (
        long.where(F.col(identity).isNotNull() & (F.col(identity) != ""))
        .groupBy(key, identity, "column")
        .agg(
            F.sum("n").alias("identity_rows"),
            F.min(filled).alias("value"),
            F.max(filled).alias("last"),
        )
        .where(F.col("value") == F.col("last"))
    )
    other = F.when(F.col(identity) != "", F.col(identity))
    reverse = (
        long.where("value is not null")
        .groupBy(key, "column", "value")
        .agg(
            F.sum("n").alias("value_rows"),
            F.min(other).alias("first_identity"),
            F.max(other).alias("last_identity"),
        )
        .where(F.col("first_identity") == F.col("last_identity"))
    )
    return (
        forward.join(reverse, [key, "column", "value"])
        .where(
            (F.col("first_identity") == F.col(identity))
            & (F.col("identity_rows") == F.col("value_rows"))
        )
        .select(key, identity, "column", "value")
    )


def alternative_signals(
    points: DataFrame,
    identity: str,
    metrics: list[str],
    period: Column,
    threshold,
    minimum: int = 2,
) -> DataFrame:
    """F30. Further metrics that prove the same transition on an identity."""
    facts = threshold_facts(
        points.where(F.col("metric").isin(*metrics)),
        [identity, "metric"],
        period,
        "value",
        threshold,
        empty_as_zero=True,
    )
    return facts.where(transition_proven(minimum))


# The event reason and the message part of a failed container start.
FAILED_REASON = "Failed"
MISSING_EXECUTABLE = "executable file not found in $PATH"


def direct_log_evidence(
    logs: DataFrame,
    period: Column,
    keys: list[str],
    reason: str = FAILED_REASON,
    fragment: str = MISSING_EXECUTABLE,
) -> DataFrame:
    """F31. Containers whose failure events start with the incident.

    The message is a JSON object with `object.reason`, `object.note` and
    `object.regarding.fieldPath`; the container is named by the field path.
    """
    event = F.from_json(
        "message",
        "object struct<reason:string,note:string,regarding:struct<fieldPath:string>>",
    )["object"]
    read = logs.select(
        *keys,
        period.alias("_p"),
        event["reason"].alias("reason"),
        F.coalesce(event["note"], F.lit("")).alias("note"),
        F.regexp_extract(event["regarding"]["fieldPath"], r"^spec\.containers\{(.+)\}$", 1).alias(
            "container"
        ),
    )
    hits = read.where(
        (F.col("reason") == reason) & F.col("note").contains(fragment) & (F.col("container") != "")
    )
    counted = hits.groupBy(*keys, "container").agg(
        F.count_if(F.col("_p") == "normal").alias("normal_count"),
        F.count_if(F.col("_p") == "abnormal").alias("abnormal_count"),
    )
    return counted.withColumn(
        "proven", (F.col("normal_count") == 0) & (F.col("abnormal_count") >= 1)
    )


def minimum_hits(count, average, maximum, threshold) -> Column:
    """F33. Fewest rows at or above the threshold that (count, mean, maximum) allow."""
    n, a, m, t = _c(count), _c(average), _c(maximum), _c(threshold)
    bound = F.floor(n * (a - t) / (m - t)) + 1
    return (
        F.when((n <= 0) | (m < a), F.lit(None).cast("bigint"))
        .when(m < t, F.lit(0))
        .when(m == t, F.when(a == t, n).otherwise(F.lit(1)))
        .when(a <= t, F.lit(1))
        .otherwise(F.least(n, F.greatest(F.lit(1), bound)))
        .cast("bigint")
    )


def in_canonical_unit(value, scale) -> Column:
    """F96. Submitted value times the linear scale of its unit."""
    return _c(value) * _c(scale)


def inconsistent_summary(minimum, average, maximum) -> Column:
    """F96. Extremes in the wrong order, or a mean outside of them."""
    lo, mean, hi = _c(minimum), _c(average), _c(maximum)
    return (
        F.coalesce(lo > hi, F.lit(False))
        | F.coalesce(mean < lo, F.lit(False))
        | F.coalesce(mean > hi, F.lit(False))
    )


def timestamp_floor(first, last) -> Column:
    """F35. Rows that two timestamp extremes prove: two if they differ, else one."""
    a, b = _c(first), _c(last)
    return F.when(b > a, F.lit(2)).when(b == a, F.lit(1)).cast("bigint")


def period_facts(rows: DataFrame, case: str) -> DataFrame:
    """F34/F96. What submitted aggregate rows prove per case.

    Columns: `case`, period (null = the bucket straddles the boundary), n, lo,
    hi, mean, scale, threshold; lo, hi and mean may be null. An inconsistent row
    rejects its case. A straddling bucket leaves a hole, so the baseline of the
    case cannot count as complete any more; a row whose hits are unknown makes
    its period unproven.
    """
    lo = in_canonical_unit("lo", "scale")
    hi = in_canonical_unit("hi", "scale")
    mean = in_canonical_unit("mean", "scale")
    n, t = F.col("n"), F.col("threshold")
    high = (
        F.when(lo >= t, n)
        .when(hi < t, F.lit(0))
        .when(mean.isNotNull() & hi.isNotNull(), minimum_hits(n, mean, hi, t))
        .when(hi >= t, F.lit(1))
    )
    attributed = F.col("period").isNotNull()
    bad = attributed & (
        F.coalesce(n <= 0, F.lit(True)) | inconsistent_summary(lo, mean, hi)
    )
    judged = rows.withColumn("_high", high).withColumn("_bad", bad)
    parts = [
        F.bool_or("_bad").alias("_rejected"),
        F.bool_or(~attributed).alias("_hole"),
    ]
    for p in ("normal", "abnormal"):
        here = F.col("period") == p
        parts += [
            F.coalesce(F.sum(F.when(here, n)), F.lit(0)).alias(f"_{p}_count"),
            F.coalesce(F.sum(F.when(here, F.coalesce("_high", F.lit(0)))), F.lit(0)).alias(
                f"_{p}_high"
            ),
            F.coalesce(F.bool_and(F.when(here, F.col("_high").isNotNull())), F.lit(False)).alias(
                f"_{p}_valid"
            ),
        ]
    summed = judged.groupBy(case).agg(*parts)
    kept = ~F.col("_rejected")
    return summed.select(
        case,
        F.col("_rejected").alias("rejected"),
        F.when(kept, F.col("_normal_count")).alias("normal_count"),
        F.when(kept, F.col("_normal_high")).alias("normal_high_count"),
        F.when(kept, F.col("_abnormal_count")).alias("abnormal_count"),
        F.when(kept, F.col("_abnormal_high")).alias("abnormal_high_count"),
        F.when(kept, F.col("_normal_valid") & ~F.col("_hole")).alias("normal_proven"),
        F.when(kept, F.col("_abnormal_valid")).alias("abnormal_proven"),
    )


def conditional_floors(rows: DataFrame, case: str, restart: str) -> DataFrame:
    """F95. Observation floors from per-period extreme columns.

    A row with a normal maximum is one observation. An abnormal row proves two
    high observations when both extremes reach the threshold and differ, one
    when they are equal or only the maximum does; a restart counter proves as
    many as thresholds fit into its maximum.
    """
    t = F.col("threshold")
    hi, lo = F.col("abnormal_max"), F.col("abnormal_min")
    floor = (
        F.when(lo >= t, F.when(lo != hi, F.lit(2)).otherwise(F.lit(1)))
        .when(hi >= t, F.when(F.col(restart) & (t > 0), F.floor(hi / t)).otherwise(F.lit(1)))
        .otherwise(F.lit(0))
        .cast("bigint")
    )
    abnormal = F.coalesce(F.sum(F.when(hi.isNotNull(), floor)), F.lit(0))
    return rows.groupBy(case).agg(
        F.count("normal_max").alias("normal_count"),
        F.count_if(F.col("normal_max") >= t).alias("normal_high_count"),
        abnormal.alias("abnormal_count"),
        abnormal.alias("abnormal_high_count"),
        (F.count("normal_max") > 0).alias("normal_proven"),
        (abnormal > 0).alias("abnormal_proven"),
    )


#: Code points of the longest grams that are indexed.
GRAM = 3
#: Values of one gram that one task compares with the gram's patterns.
POSTINGS = 10_000
# Ends of a text; a literal at an end of its pattern holds one, so that it is looked up anchored.
_BEGIN, _END = "\x02", "\x03"


def _enclosed(text: Column) -> Column:
    return F.concat(F.lit(_BEGIN), text, F.lit(_END))


def _literals(pattern: Column) -> Column:
    """What stands between the wildcards of a LIKE pattern, without escapes."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:[^%_\\]|\\.)+)"), F.lit(1))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))


def _grams(texts: Column, most: int, least: int | None = None) -> Column:
    """Distinct parts of the texts: of `most` code points, of a shorter text the whole of it.

    With `least`, texts shorter than that give none.
    """
    if least is not None:
        texts = F.filter(texts, lambda t: F.length(t) >= least)

    def parts(t: Column) -> Column:
        size = F.least(F.lit(most), F.length(t))
        return F.transform(F.sequence(F.lit(1), F.length(t) - size + 1), lambda i: F.substring(t, i, size))

    return F.array_distinct(F.flatten(F.transform(texts, parts)))


def _pattern_grams(patterns: DataFrame) -> DataFrame:
    """Adds `_folded`, the text that is compared, and `_grams`; none for a pattern of wildcards only."""
    text = F.when(F.col("ignore_case"), F.lower("pattern")).otherwise(F.col("pattern"))
    tagged = patterns.withColumn("_folded", F.coalesce("ignore_case", F.lit(False))).withColumn("_text", text)
    literal = F.size(_literals(F.col("_text"))) > 0
    # Ends count as literals only beside others: alone they are in every value.
    parts = F.when(literal, _literals(_enclosed(F.col("_text")))).otherwise(F.array().cast("array<string>"))
    tagged = tagged.withColumn("_parts", parts)
    # An end on its own is no gram; a literal of one code point is.
    telling = F.filter("_parts", lambda p: ~p.isin(_BEGIN, _END))
    return tagged.withColumn("_grams", _grams(telling, GRAM))


def _value_grams(domains: DataFrame) -> DataFrame:
    """column, value, _folded, _gram for all grams of the values, as they are and in lower case."""
    texts = F.explode(F.array(
        F.struct(F.lit(False).alias("folded"), F.col("value").alias("text")),
        F.struct(F.lit(True).alias("folded"), F.lower("value").alias("text")),
    ))
    both = domains.where("value is not null").select("column", "value", texts.alias("t"))
    sizes = F.flatten(F.array(*[_grams(F.array(_enclosed(F.col("t.text"))), n, n) for n in range(1, GRAM + 1)]))
    return both.select("column", "value", F.col("t.folded").alias("_folded"), F.explode(sizes).alias("_gram"))


def pattern_candidates(patterns: DataFrame, domains: DataFrame) -> DataFrame:
    """The values that each distinct pattern with a literal must be compared with: those that hold its rarest gram.

    A gram's values are dealt in slices of about `POSTINGS`, as many as it needs; the gram's patterns
    visit each slice.
    """
    keys = ["column", "_folded", "_gram"]
    asked = patterns.select("*", F.explode("_grams").alias("_gram"))
    held = _value_grams(domains).join(asked.select(*keys).distinct(), keys, "left_semi")
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    named = ["column", "_folded", "pattern", "ignore_case", "target"]
    # A gram that no value holds is the rarest, and ends the search.
    rarest = asked.join(counts, keys, "left").groupBy(*named).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_r")
    ).where("_r._n > 0").select(*named, "_r._gram", F.ceil(F.col("_r._n") / POSTINGS).cast("int").alias("_slices"))
    used = rarest.select(*keys, "_slices").distinct()
    dealt = held.join(used, keys).withColumn("_slice", F.pmod(F.xxhash64("value"), F.col("_slices")).cast("int"))
    visiting = rarest.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return visiting.join(dealt.drop("_slices"), [*keys, "_slice"]).select(*named, "value")


def pattern_bindings(patterns: DataFrame, domains: DataFrame) -> DataFrame:
    """E18. Whether a LIKE pattern matches exactly its target in the identity domain.

    `patterns`: pattern_id, column, pattern, ignore_case, target. `domains`: column, value
    (distinct). Equal patterns are matched once. An index of grams of one to three code points leads
    each pattern to the values that hold its rarest gram; these are compared with LIKE, and matches
    are only counted. Patterns of wildcards only ask nothing but a length, and are counted from a
    histogram of lengths.
    """
    named = ["column", "pattern", "ignore_case", "target"]
    distinct = _pattern_grams(patterns.select(*named).distinct())
    like = F.when(F.col("ignore_case"), F.expr("value ILIKE pattern")).otherwise(
        F.expr("value LIKE pattern")
    )
    told = pattern_candidates(distinct.where(F.size("_grams") > 0), domains).where(like).groupBy(*named).agg(
        F.count(F.lit(1)).alias("_n"))
    sized = F.explode(F.array(*[
        F.struct(F.lit(folded).alias("folded"), F.length(text).alias("length"))
        for folded, text in ((False, F.col("value")), (True, F.lower("value")))
    ]))
    lengths = domains.where("value is not null").select("column", sized.alias("t")).groupBy(
        "column", F.col("t.folded").alias("_folded"), F.col("t.length").alias("_length")
    ).agg(F.count(F.lit(1)).alias("_n"))
    blanks = F.length(F.regexp_replace("_text", "[^_]", ""))
    open_ = distinct.where((F.size("_grams") == 0) & F.col("pattern").isNotNull()).select(
        *named, "_folded", blanks.alias("_blanks"), F.contains("_text", F.lit("%")).alias("_any"))
    fits = (F.col("_length") == F.col("_blanks")) | (F.col("_any") & (F.col("_length") > F.col("_blanks")))
    blank = open_.join(lengths, ["column", "_folded"]).where(fits).groupBy(*named).agg(F.sum("_n").alias("_n"))
    targets = distinct.select(*named).join(
        domains.select("column", F.col("value").alias("target"), "value").distinct(), ["column", "target"]
    ).where(like).select(*named, F.lit(True).alias("_hit"))
    found = told.unionByName(blank)
    both = patterns.alias("l").join(found.alias("r"), same_keys(patterns, found, named), "left")
    counted = both.select("l.*", F.coalesce("_n", F.lit(0)).alias("matches"))
    bound = counted.alias("l").join(targets.alias("r"), same_keys(patterns, targets, named), "left")
    return bound.select(
        "pattern_id", "matches", ((F.col("matches") == 1) & F.coalesce("_hit", F.lit(False))).alias("binds")
    )


def boundary_split(spans: DataFrame, cases: DataFrame) -> DataFrame:
    """C10. Where minute bins may be split for a boundary inside of a minute.

    `cases`: case_id, boundary (seconds). The split is possible on a whole
    minute, or when only one side of the shared minute has client spans.
    """
    minute = W.floor_to("boundary", 60)
    per_second = (
        spans.where(F.col("span_kind") == "SPAN_KIND_CLIENT")
        .groupBy(W.floor_div("ts_ns", 1_000_000_000).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("minute", W.floor_to("s", 60))
    )
    counted = (
        cases.withColumn("minute", minute)
        .join(per_second, "minute", "left")
        .groupBy("case_id", "boundary", "minute")
        .agg(
            F.coalesce(F.sum(F.when(F.col("s") < F.col("boundary"), F.col("n"))), F.lit(0)).alias(
                "normal_clients"
            ),
            F.coalesce(F.sum(F.when(F.col("s") >= F.col("boundary"), F.col("n"))), F.lit(0)).alias(
                "abnormal_clients"
            ),
        )
    )
    whole = F.col("boundary") == F.col("minute")
    supported = whole | (F.col("normal_clients") == 0) | (F.col("abnormal_clients") == 0)
    split = F.when(whole, F.col("boundary")).otherwise(
        F.when(F.col("normal_clients") > 0, F.col("minute") + 60).otherwise(F.col("minute"))
    )
    return counted.select(
        "case_id",
        F.col("minute").alias("boundary_minute"),
        "normal_clients",
        "abnormal_clients",
        supported.alias("split_supported"),
        F.when(supported, split).alias("split"),
    )


def claim_verdicts(scopes: DataFrame, minimum: int = 2) -> DataFrame:
    """F40. Rejection codes of a claim from its scope flags and facts.

    Columns: periods, complete_periods, proven_periods (arrays), value_independent,
    result_complete, normal_count, normal_high_count, abnormal_high_count; facts
    are null when nothing was measured.
    """

    def has(column: str, period: str) -> Column:
        return F.array_contains(column, period)

    no_facts = F.col("normal_count").isNull()
    baseline = F.array_compact(
        F.array(
            F.when(~has("periods", "normal"), "period_not_covered").when(
                ~has("complete_periods", "normal"), "time_coverage_incomplete"
            ),
            F.when(~F.col("value_independent"), "value_filtered_for_universal_claim"),
            F.when(~F.col("result_complete"), "result_incomplete"),
            F.when(~has("proven_periods", "normal") | no_facts, "lineage_unproven")
            .when(F.col("normal_count") < 1, "baseline_observations_missing")
            .when(F.col("normal_high_count") > 0, "baseline_threshold_violation"),
        )
    )
    anomaly = F.array_compact(
        F.array(
            F.when(~has("periods", "abnormal"), "period_not_covered"),
            F.when(~has("proven_periods", "abnormal") | no_facts, "lineage_unproven").when(
                F.col("abnormal_high_count") < minimum, "insufficient_anomalous_observations"
            ),
        )
    )
    judged = scopes.withColumn("baseline_rejection_codes", baseline).withColumn(
        "anomaly_rejection_codes", anomaly
    )
    clear = F.size("baseline_rejection_codes") == 0
    present = F.size("anomaly_rejection_codes") == 0
    return judged.withColumn("baseline_clear", clear).withColumn(
        "anomaly_present", present
    ).withColumn(
        "rejection_codes",
        F.when(
            ~clear & ~present,
            F.array_distinct(F.concat("baseline_rejection_codes", "anomaly_rejection_codes")),
        ).otherwise(F.array().cast("array<string>")),
    )
