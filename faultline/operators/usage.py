"""Token use and cost with strict handling of missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.statistics import null_strict_sum, only_value

MILLION = 1_000_000

# The keys of the usage objects which providers return, all in one schema.
USAGE_SCHEMA = """
    input_tokens long, prompt_tokens long, total_tokens long,
    prompt_cache_hit_tokens long, prompt_cache_miss_tokens long,
    cache_read_input_tokens long, cache_creation_input_tokens long,
    input_tokens_details struct<
        cached_tokens: long, cache_write_tokens: long, cache_creation_input_tokens: long>,
    prompt_tokens_details struct<
        cached_tokens: long, cache_write_tokens: long, cache_creation_input_tokens: long>,
    x_details array<struct<prompt_tokens_details: struct<
        cached_tokens: long, cache_write_tokens: long, cache_creation_input_tokens: long>>>
"""


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def response_breakdown(usage: str = "usage") -> dict[str, Column]:
    """F53. Uncached, cache-read and cache-write input of one response's usage object.

    Four shapes are known: hit and miss counters, read and creation counters, nested
    details, and a list of details. A shape is recognized by the keys it has.
    """
    u = F.from_json(usage, USAGE_SCHEMA)
    keys = F.json_object_keys(usage)

    def has(*names: str) -> Column:
        found = F.lit(True)
        for name in names:
            found = found & F.array_contains(keys, name)
        return F.coalesce(found, F.lit(False))

    hit_miss = has("prompt_cache_hit_tokens", "prompt_cache_miss_tokens")
    read_write = has("cache_read_input_tokens", "cache_creation_input_tokens")
    tokens = _zero(
        F.when(has("input_tokens"), u["input_tokens"]).otherwise(u["prompt_tokens"])
    )
    details = F.when(has("input_tokens_details"), u["input_tokens_details"]).otherwise(
        u["prompt_tokens_details"]
    )
    listed = u["x_details"]
    list_ok = (F.size(listed) > 0) & F.forall(
        listed,
        lambda d: d["prompt_tokens_details"]["cached_tokens"].isNotNull()
        & d["prompt_tokens_details"]["cache_creation_input_tokens"].isNotNull(),
    )
    use_list = F.coalesce(list_ok, F.lit(False))

    def total(field: str) -> Column:
        return F.aggregate(
            listed,
            F.lit(0).cast("bigint"),
            lambda a, d: a + _zero(d["prompt_tokens_details"][field]),
        )

    def nonzero(*values: Column) -> Column:
        return _zero(F.coalesce(*[F.nullif(v, F.lit(0)) for v in values]))

    cached = F.when(use_list, total("cached_tokens")).otherwise(_zero(details["cached_tokens"]))
    written = F.when(use_list, total("cache_creation_input_tokens")).otherwise(
        nonzero(
            details["cache_write_tokens"],
            details["cache_creation_input_tokens"],
            u["cache_creation_input_tokens"],
        )
    )
    nested_ok = (
        details.isNotNull() & (tokens >= 0) & (cached >= 0) & (written >= 0)
        & (cached + written <= tokens)
    )
    nested = F.coalesce(nested_ok, F.lit(False))

    def pick(first: Column, second: Column, third: Column) -> Column:
        return (
            F.when(hit_miss, first).when(read_write, second).when(nested, third)
            .otherwise(F.lit(0).cast("bigint"))
        )

    zero = F.lit(0).cast("bigint")
    creation = F.coalesce(
        details["cache_write_tokens"],
        details["cache_creation_input_tokens"],
        u["cache_creation_input_tokens"],
    )
    return {
        "uncached": pick(
            _zero(u["prompt_cache_miss_tokens"]), _zero(u["input_tokens"]),
            tokens - cached - written,
        ),
        "cache_read": pick(
            _zero(u["prompt_cache_hit_tokens"]), _zero(u["cache_read_input_tokens"]), cached
        ),
        "cache_write": pick(zero, _zero(u["cache_creation_input_tokens"]), written),
        "split": hit_miss | read_write | nested,
        "creation_known": details.isNotNull() & (creation.isNotNull() | use_list),
    }


def input_breakdown(responses: DataFrame, keys: list[str], usage: str = "usage") -> DataFrame:
    """F53. Sums per run; complete only if every response with usage could be split.

    Responses without a usage object do not count, but leave the cache creation unknown.
    """
    parts = response_breakdown(usage)
    present = F.col(usage).isNotNull()
    read = responses.select(
        *keys, present.alias("_present"), *[v.alias(f"_{n}") for n, v in parts.items()]
    )
    here = F.col("_present")
    return read.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(here, F.col(f"_{n}"))), F.lit(0)).alias(f"{n}_input_tokens")
            for n in ("uncached", "cache_read", "cache_write")
        ],
        ((F.count_if("_present") > 0) & F.bool_and(~here | F.col("_split"))).alias(
            "cache_breakdown_complete"
        ),
        F.bool_and(here & F.coalesce("_creation_known", F.lit(False))).alias(
            "cache_creation_known"
        ),
    )


def estimated_cost() -> Column:
    """F54. Cost of a run joined with its frozen rates per million tokens.

    Null as soon as a needed rate or the cache breakdown is missing. Rates:
    cost_available, creation_required, input_rate, hit_rate, write_rate, output_rate.
    """
    complete = F.col("cache_breakdown_complete")
    uncached = F.when(complete, F.col("uncached_input_tokens")).otherwise(
        _zero(F.col("input_tokens"))
    )
    missing = (
        (~F.coalesce("cost_available", F.lit(True)))
        | (F.coalesce("creation_required", F.lit(False)) & ~F.col("cache_creation_known"))
        | (F.col("hit_rate").isNotNull() & ~complete)
        | ((F.col("cache_read_input_tokens") > 0) & F.col("hit_rate").isNull())
        | ((F.col("cache_write_input_tokens") > 0) & F.col("write_rate").isNull())
    )
    zero = F.lit(0.0)
    cost = (
        uncached * F.col("input_rate")
        + F.col("cache_write_input_tokens") * F.coalesce("write_rate", zero)
        + F.col("cache_read_input_tokens") * F.coalesce("hit_rate", zero)
        + _zero(F.col("output_tokens")) * F.col("output_rate")
    ) / MILLION
    return F.when(~missing, cost)


def cache_observation(responses: DataFrame, keys: list[str], usage: str = "usage") -> DataFrame:
    """F55. Known cached, known uncached and unknown input of runs with partial cache detail."""
    u = F.from_json(usage, USAGE_SCHEMA)
    tokens, total = u["prompt_tokens"], u["total_tokens"]
    cached = u["prompt_tokens_details"]["cached_tokens"]
    counts_ok = F.coalesce((tokens >= 0) & (tokens <= total), F.lit(False))
    cached_ok = F.coalesce((cached >= 0) & (cached <= tokens), F.lit(True))
    message = F.raise_error(F.lit("invalid response token counts")).cast("bigint")
    checked = F.when(counts_ok & cached_ok, tokens).otherwise(message)
    read = responses.select(
        *keys, checked.alias("_t"), (total - tokens).alias("_o"), cached.alias("_c")
    )
    known = F.col("_c").isNotNull()
    return read.groupBy(*keys).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("known_cached"),
        F.coalesce(F.sum(F.when(known, F.col("_t") - F.col("_c"))), F.lit(0)).alias(
            "known_uncached"
        ),
        F.coalesce(F.sum(F.when(~known, F.col("_t"))), F.lit(0)).alias("unknown_cache"),
        F.sum("_o").alias("output_tokens"),
    )


def cost_bounds(observed: DataFrame) -> DataFrame:
    """F55. Lowest and highest cost: unknown input is all cached or all uncached."""
    ordinary, hit = F.col("input_rate"), F.col("hit_rate")
    sound = F.coalesce((hit >= 0) & (hit <= ordinary), F.lit(False))
    known = (
        F.col("known_cached") * hit
        + F.col("known_uncached") * ordinary
        + F.col("output_tokens") * F.col("output_rate")
    ) / MILLION
    bad = F.raise_error(F.lit("invalid frozen cache prices")).cast("double")
    low = known + F.col("unknown_cache") * hit / MILLION
    high = known + F.col("unknown_cache") * ordinary / MILLION
    return observed.withColumn("cost_low", F.when(sound, low).otherwise(bad)).withColumn(
        "cost_high", F.when(sound, high).otherwise(bad)
    )


def bounded_costs(runs: DataFrame) -> DataFrame:
    """F55. Bounds per model and treatment; a model in two currencies ends the job."""
    per_model = runs.groupBy("model").agg(only_value("currency").alias("currency"))
    totals = runs.groupBy("model", "treatment").agg(
        F.sum("cost_low").alias("cost_low"), F.sum("cost_high").alias("cost_high")
    )
    problem = F.raise_error(F.lit("bounded model costs span currencies")).cast("string")
    return totals.join(per_model, "model").withColumn(
        "currency", F.coalesce("currency", problem)
    )


def usage_totals(runs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """F56. Null-strict sums, and a currency only if there is exactly one."""
    return runs.groupBy(*keys).agg(
        *[null_strict_sum(f).alias(f) for f in fields],
        only_value("currency").alias("currency"),
        F.coalesce(F.bool_and("cache_breakdown_complete"), F.lit(True)).alias(
            "cache_breakdown_complete"
        ),
    )


def priced_models(runs: DataFrame) -> DataFrame:
    """F57. Whether every run of a model is priced in one currency."""
    priced = F.col("cost").isNotNull() & (F.coalesce("currency", F.lit("")) != "")
    return runs.groupBy("model").agg(
        F.when(
            F.bool_and(priced) & (F.min("currency") == F.max("currency")), F.min("currency")
        ).alias("priced_currency")
    )


def usage_by_treatment(runs: DataFrame, usd_rates: DataFrame) -> DataFrame:
    """F57. Tokens of all runs and spend in USD per treatment.

    Spend counts only models priced in one currency everywhere; it is null when
    no model is. A currency without a rate ends the job. Runs fold to model and
    treatment before the gate is joined back.
    """
    folded = runs.groupBy("model", "treatment").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("cost").alias("cost"),
    )
    rated = folded.join(priced_models(runs), "model").join(
        usd_rates.select(F.col("currency").alias("priced_currency"), "per_unit_usd"),
        "priced_currency",
        "left",
    )
    missing = F.raise_error(
        F.concat(F.lit("no frozen exchange rate for currency: "), "priced_currency")
    ).cast("double")
    rate = F.when(
        F.col("priced_currency").isNotNull(), F.coalesce("per_unit_usd", missing)
    )
    return rated.withColumn("_usd", F.col("cost") * rate).groupBy("treatment").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("priced_currency").isNotNull()).alias("priced_models"),
        F.sum("_usd").alias("estimated_cost_usd"),
    )


def spend_by_currency(runs: DataFrame) -> DataFrame:
    """F57. Spend of the priced models per treatment in the currency it was billed in."""
    folded = runs.groupBy("model", "treatment").agg(F.sum("cost").alias("cost"))
    return (
        folded.join(priced_models(runs), "model")
        .where("priced_currency is not null")
        .groupBy("treatment", F.col("priced_currency").alias("currency"))
        .agg(F.sum("cost").alias("spend"))
    )


def cost_report(parts: DataFrame) -> DataFrame:
    """F58. Cost status per model from its cohort parts.

    `parts`: model, cohort, cost, currency, cost_available, breakdown_complete.
    """
    grouped = parts.groupBy("model").agg(
        null_strict_sum("cost").alias("cost"),
        only_value("currency").alias("currency"),
        F.bool_and(F.coalesce("cost_available", F.lit(True))).alias("_available"),
        F.bool_and("breakdown_complete").alias("_complete"),
    )
    available = F.col("cost").isNotNull() & F.col("currency").isNotNull()
    return grouped.select(
        "model",
        F.when(available, "available").otherwise("not_estimable").alias("status"),
        F.col("cost").alias("estimated_cost"),
        "currency",
        F.when(
            ~available,
            F.when(~F.col("_available"), "model_price_not_frozen")
            .when(~F.col("_complete"), "cache_breakdown_incomplete")
            .otherwise("usage_not_priceable"),
        ).alias("reason_code"),
    )


def cost_totals(report: DataFrame) -> DataFrame:
    """F58. Known totals per currency."""
    return (
        report.where(F.col("status") == "available")
        .groupBy("currency")
        .agg(F.sum("estimated_cost").alias("known_total"))
    )


def cross_currency_total(report: DataFrame, usd_rates: DataFrame) -> DataFrame:
    """F58. One USD amount, null as soon as a model has no price."""
    joined = report.join(usd_rates, "currency", "left")
    usd = F.when(F.col("status") == "available", F.col("estimated_cost") * F.col("per_unit_usd"))
    return joined.agg(null_strict_sum(usd).alias("usd_total"))


def family_cost_agreement(costs: DataFrame) -> DataFrame:
    """F58. Costs of one arm that two families report differently; must be empty."""
    return (
        costs.groupBy("model", "treatment")
        .agg(
            F.count(F.lit(1)).alias("families"),
            F.count("cost").alias("known"),
            F.min("cost").alias("low"),
            F.max("cost").alias("high"),
        )
        .where(
            ((F.col("known") > 0) & (F.col("known") < F.col("families")))
            | (F.col("low") < F.col("high"))
        )
    )
