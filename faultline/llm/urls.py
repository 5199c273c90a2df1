"""URL filter: association rules over URL tokens, mined by FP-growth, matched by inverted index.

Labelled URLs become sets of tokens: scheme, top-level domain, domain, every other host label and
the words of hyphenated labels, every path segment, ending, every query name, fragment. Where the
label is a fixed rule's verdict, the tokens that this rule tests are left out, as they say nothing
but the rule. FP-growth finds the frequent token sets together with their label; a set becomes a
rule when its support and its confidence reach the thresholds, its confidence is above the share
of the label by more than chance, and no subset of it does as well (pruning). Each rule is filed in
the index under its rarest token, so a URL looks up only rules that have one of its tokens.

Nulls and texts without "://" have an empty host and path and only the token `no-host`; they are
judged like any other. Repeated rows count as often as they occur. Without labels there are no
rules and the default verdict holds.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a usual URL are fewer; all are kept where there are more.
TOKEN_PLACES = 64
#: Chance of one wrong rule among all that are tried.
CHANCE = 0.05


@dataclass(frozen=True)
class PathRule:
    """A verdict for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[PathRule]) -> Column:
    """The longest rule (host and path together) that fits, as its name; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = (host == rule.host) | host.endswith("." + rule.host)
        found = F.when(own & path.startswith(rule.path), F.lit(rule.name)).otherwise(found)
    return found


def _named(kind: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))


def _words(labels: Column) -> Column:
    return F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))


def _segments(path: Column) -> Column:
    return F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "0"))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    text = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.element_at(labels, -1)
    domain = F.when(n >= 2, F.concat_ws(".", F.element_at(labels, F.greatest(n - 1, F.lit(1))), last))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    rest = F.regexp_extract(text, r"(?s)://[^?#]*(.*)", 1)
    query = F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1)
    places = [
        F.concat(F.lit("scheme="), F.regexp_extract(text, r"(?s)^([^:/]*)://", 1)),
        F.concat(F.lit("top="), last),
        F.concat(F.lit("domain="), domain),
        F.when(ending != "", F.concat(F.lit("ending="), F.lower(ending))),
        F.when(rest.startswith("?"), F.lit("query")),
        F.when(rest.contains("#"), F.lit("fragment")),
    ]
    before = F.slice(labels, 1, F.greatest(n - 1, F.lit(0)))
    known = F.array_distinct(F.concat(
        F.filter(F.array(*places), lambda x: x.isNotNull()), _named("host", before), _named("word", _words(before)),
        _named("dir", _segments(path)), _named("query", F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, "(?s)^[^=]*", 0))),
    ))
    return F.when(host == "", F.array(F.lit("no-host"))).otherwise(known)


def independent_tokens(url: Column, rule: Column, rules: list[PathRule]) -> Column:
    """The tokens of a URL without those that its fixed rule tests."""
    tokens = url_tokens(url)
    out = tokens
    for r in rules:
        labels = F.split(F.lit(r.host), r"\.")
        tested = F.concat(_named("host", labels), _named("word", _words(labels)), _named("dir", _segments(F.lit(r.path))))
        # The top-level domain and the domain have the rule's host or a part of it in them.
        own = F.filter(F.array_except(tokens, tested), lambda x: ~(x.startswith("top=") | x.startswith("domain=")))
        out = F.when(rule == r.name, own).otherwise(out)
    return out


def beyond_chance(hits: int, rows: int, share: float, tried: int) -> bool:
    """Whether `hits` of `rows` are too many for a label of this share, by Chernoff's bound for all `tried`."""
    rate = hits / rows
    if rate <= share:
        return False
    gain = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return rows * gain >= math.log(max(tried, 1) / CHANCE)


def mine_rules(
    labelled: DataFrame, label: str = "block", support: float = 0.002, confidence: float = 0.97
) -> list[tuple[tuple[str, ...], float, float]]:
    """Token sets that imply `label`, from columns tokens and label.

    Before sets are grown, tokens are taken out that no larger rule can have: those too rare with
    the label, and those that are a rule alone. Tokens of the same rows are grown as one. Tokens
    number at most (tokens a URL) / support, at any input size.
    Returns (tokens, support, confidence), sorted; a rule whose subset is a rule too is pruned.
    """
    marked = F.col("label") == label
    counted = labelled.select("tokens", marked.alias("hit"), F.xxhash64("tokens").alias("row"))
    total, hits = counted.agg(F.count(F.lit(1)), F.count_if("hit")).first()
    least = max(1, math.ceil(support * total))
    if hits < least:
        return []
    share = hits / total
    # Tokens with the same rows have the same sums.
    alone = counted.select(F.explode("tokens").alias("token"), "hit", "row").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("k"),
        F.sum(F.col("row").cast("decimal(38,0)")).alias("rows"))
    classes: dict[tuple, list[str]] = {}
    single: list[tuple[str, int, int]] = []
    for r in alone.where(F.col("k") >= least).collect():
        if r.k >= confidence * r.n:
            single.append((r.token, r.n, r.k))
        else:
            classes.setdefault((r.n, r.k, r.rows), []).append(r.token)
    members = {min(c): sorted(c) for c in classes.values()}
    sets: dict[frozenset, int] = {}
    mark = "label=" + label
    if members:
        grown = F.array_intersect("tokens", F.array(*[F.lit(t) for t in sorted(members)]))
        baskets = labelled.select(F.concat(grown, F.when(marked, F.array(F.lit(mark))).otherwise(
            F.array().cast("array<string>"))).alias("items"))
        parts = max(2, baskets.sparkSession.sparkContext.defaultParallelism)
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence,
                         numPartitions=parts).fit(baskets)
        sets = {frozenset(r["items"]): r["freq"] for r in model.freqItemsets.collect()}
    found = [(frozenset([t]), n, k) for t, n, k in single]
    found += [(s - {mark}, sets[s - {mark}], k) for s, k in sets.items() if mark in s and len(s) > 2]
    rules: list[tuple[tuple[str, ...], float, float]] = []
    kept: list[frozenset] = []
    for body, n, k in sorted(found, key=lambda f: (len(f[0]), sorted(f[0]))):
        if k < confidence * n or any(b <= body for b in kept) or not beyond_chance(k, n, share, len(found)):
            continue
        kept.append(body)
        same = itertools.product(*[members.get(t, [t]) for t in sorted(body)])
        rules += [(tuple(sorted(tokens)), k / total, k / n) for tokens in same]
    return rules


def inverted_index(rules: list) -> dict[str, list[tuple[frozenset, float]]]:
    """Rules by their rarest token (fewest rules have it)."""
    uses: dict[str, int] = {}
    for body, _, _ in rules:
        for token in body:
            uses[token] = uses.get(token, 0) + 1
    index: dict[str, list[tuple[frozenset, float]]] = {}
    for body, _, confidence in rules:
        index.setdefault(min(body, key=lambda t: (uses[t], t)), []).append((frozenset(body), confidence))
    return index


def best_confidence(tokens: Column, rules: list) -> Column:
    """The highest confidence of a rule whose tokens the URL all has; null if there is none."""
    index = inverted_index(rules)

    @F.pandas_udf("double")
    def look_up(column: pd.Series) -> pd.Series:
        out = []
        for found in column:
            own = set(found) if found is not None else set()
            out.append(max((c for t in own for body, c in index.get(t, ()) if body <= own), default=None))
        return pd.Series(out, dtype="float64")

    return look_up(tokens)


def judge_urls(
    pages: DataFrame,
    path_rules: list[PathRule],
    labelled: DataFrame | None = None,
    support: float = 0.002,
    confidence: float = 0.97,
    url: str = "url",
) -> DataFrame:
    """Adds host, path, rule, confidence and verdict to `pages`.

    A fixed path rule decides first. Mined rules decide the rest: block where one matches, else
    allow. `labelled` has columns url and label ("allow" or "block"); by default the URLs that the
    path rules decide are the labelled ones, without the tokens that the deciding rule tests.
    """
    verdicts = {r.name: r.verdict for r in path_rules}
    judged = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), path_rules))
    ruled = F.lit(None).cast("string")
    for name, verdict in sorted(verdicts.items()):
        ruled = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(ruled)
    if labelled is None:
        learned = judged.where(F.col("rule").isNotNull()).select(
            independent_tokens(F.col(url), F.col("rule"), path_rules).alias("tokens"), ruled.alias("label"))
    else:
        learned = labelled.select(url_tokens(F.col("url")).alias("tokens"), "label")
    mined = mine_rules(learned, support=support, confidence=confidence)
    judged = judged.withColumn("confidence", best_confidence(url_tokens(F.col(url)), mined))
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", F.coalesce(ruled, method))
