"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose measure lies beyond a cutoff. Cutoffs come from labelled holdouts:
with confidence 1 - `error` over all strata and rules together, no more than `risk` of a stratum's good
documents are rejected by all its rules taken together.

Candidates are quantiles of the measure over the rows without a label, from far out inwards, so they
are independent of the holdouts. For each (stratum, rule) the hypothesis "this cutoff rejects more than
risk / rules of the good documents" is tested with the exact binomial tail, candidate after candidate,
and testing stops at the first one that is not refuted: a fixed sequence needs no correction of its
own. Across rules and strata the first candidates are corrected by Bonferroni. Of the cutoffs that are
refuted, the one that rejects most bad holdouts less `price` times good ones (as shares) is used; none,
if none is worth it. A stratum with too few good holdouts gets no cutoff and keeps its documents.

Everything but the counts of strata x rules x candidates stays in Spark tables; no row is collected.

Null and empty texts have no words; their measures are null and no rule rejects them, the base rule does.
A null stratum is a stratum. Rows of one doc_id with different labels count as bad; identical rows of
one labelled document count once; labels without a document and null labels or ids say nothing. Extra
columns of the documents are ignored by `judge`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.statistics import binomial_tail
from faultline.llm import common
from faultline.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes that belong to no letter: ASCII without A-Z and a-z; other scripts count as letters.
_NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha()) + _CONTINUATION
WINDOW = 5

MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_letters long, n_distinct_words long"
)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside of windows that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside = reached = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside += i + size - max(reached, i)
            reached = i + size
    return inside


def measure(text: bytes) -> tuple[int, ...]:
    """The counts of `MEASURED` over the whole text."""
    words = text.split()
    points = len(text.translate(None, _CONTINUATION))
    spaces = len(text) - len(text.translate(None, _SPACE))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return (
        len(words), points - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(text.translate(None, _NO_LETTERS)), len(set(words)),
    )


def measured(docs: DataFrame, keep: list[str], into: str = "measured") -> DataFrame:
    """The columns `keep` and a struct of `MEASURED`."""
    kept = docs.select(*keep)
    names = [c.split()[0] for c in MEASURED.split(", ")]
    schema = ", ".join([
        *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], *[f"`_{c}` long" for c in names]])

    passed = kept.columns

    def run(batch: pa.RecordBatch) -> dict:
        counts = zip(*map(measure, common.utf8(batch.column("_text")))) if batch.num_rows else [[]] * len(names)
        return {c: batch.column(c) for c in passed} | {f"_{c}": v for c, v in zip(names, counts)}

    found = common.map_batches(docs.select(*keep, F.col("text").alias("_text")), run, schema)
    return found.select(*passed, F.struct(*[F.col(f"_{c}").alias(c) for c in names]).alias(into))


@dataclass(frozen=True)
class Rule:
    """Rejects values above the cutoff of `top` over `bottom`; below it, if `low`."""

    name: str
    top: str
    bottom: str
    low: bool = False

    def value(self, of: str = "measured") -> Column:
        """The measure, turned so that large is bad; null without a denominator."""
        share = F.try_divide(F.col(f"{of}.{self.top}").cast("double"), F.col(f"{of}.{self.bottom}"))
        return -share if self.low else share


#: Every rule takes its part of the risk, so few rules need fewer labels.
RULES = (
    Rule("symbols", "n_symbols", "n_words"),
    Rule("letters", "n_letters", "word_chars", low=True),
    Rule("long_words", "word_chars", "n_words"),
    Rule("repeated_lines", "n_dup_lines", "n_lines"),
)
#: Quantiles of unlabelled rows that are tried as cutoffs, from far out inwards.
LEVELS = (0.9999, 0.9995, 0.999, 0.998, 0.995, 0.99, 0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91, 0.9,
          0.88, 0.86, 0.84, 0.82, 0.8, 0.75, 0.7)


def candidates(values: DataFrame, stratum: str, levels: tuple[float, ...]) -> DataFrame:
    """stratum, rule, place, cutoff from rows (stratum, rule, value); equal cutoffs are one."""
    found = values.where("value is not null").groupBy(stratum, "rule").agg(
        F.percentile_approx("value", F.array(*map(F.lit, levels)), 10_000).alias("cutoffs")
    )
    places = found.select(stratum, "rule", F.posexplode("cutoffs").alias("place", "cutoff"))
    return places.groupBy(stratum, "rule", "cutoff").agg(F.min("place").alias("place"))


def certified(counts: DataFrame, stratum: str, rules: int, risk: float, error: float, price: float) -> DataFrame:
    """The cutoff of each (stratum, rule) from its counts per candidate.

    `counts` has stratum, rule, place, cutoff, good, bad (holdouts of the stratum) and good_out, bad_out
    (those beyond the cutoff). A (stratum, rule) without a worthwhile certified cutoff has no row.
    """
    counts = cut_lineage(counts, "counts")
    tests = max(1, rules * counts.select(stratum).distinct().count())
    # The chance of so few rejections, if the cutoff rejected just more than its share of the risk.
    tail = binomial_tail(F.col("good_out"), F.col("good"), risk / rules)
    order = Window.partitionBy(stratum, "rule").orderBy("place")
    failed = F.max((F.col("p") > error / tests).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    gain = F.coalesce(F.try_divide("bad_out", "bad"), F.lit(0.0)) - price * F.col("good_out") / F.col("good")
    tested = counts.where("good > 0").withColumn("p", tail).withColumn("failed", failed)
    return tested.where("failed = 0").withColumn("gain", gain).where("gain > 0").groupBy(stratum, "rule").agg(
        F.max_by(F.struct("cutoff", "place", "p", "good", "good_out", "bad", "bad_out"), F.struct("gain", -F.col("place"))).alias("c")
    ).select(stratum, "rule", "c.*")


def fit_rules(
    docs: DataFrame, labels: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, risk: float = 0.05,
    error: float = 0.05, price: float = 10.0, levels: tuple[float, ...] = LEVELS,
) -> DataFrame:
    """stratum, rule, cutoff and the counts behind it.

    `docs` has doc_id, the stratum and `measured`; `labels` has doc_id and label (1 is good). Labelled
    rows are joined by measures, not by texts.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = docs.select("doc_id", stratum, "measured").join(known, "doc_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.value().alias("value")) for r in rules])).alias("m")
    values = marked.where("label is null").select(stratum, each).select(stratum, "m.*")
    held = marked.where("label is not null").distinct().select(stratum, "label", each).select(stratum, "label", "m.*")
    # Both tables are small: counts fold before their shuffle, and a stratum has few candidates.
    cutoffs = candidates(values, stratum, levels).groupBy(stratum, "rule").agg(
        F.sort_array(F.collect_list(F.struct("cutoff", "place"))).alias("cutoffs"))
    good = F.col("label") == 1
    met = held.alias("h").join(
        cutoffs.alias("c"), F.col(f"h.{stratum}").eqNullSafe(F.col(f"c.{stratum}")) & (F.col("h.rule") == F.col("c.rule"))
    ).select(f"h.{stratum}", "h.rule", "label", "value", F.explode("cutoffs").alias("k"))
    beyond = F.coalesce(F.col("value") > F.col("k.cutoff"), F.lit(False))
    counts = met.groupBy(stratum, "rule", "k").agg(
        F.count_if(good).alias("good"), F.count_if(~good).alias("bad"),
        F.count_if(good & beyond).alias("good_out"), F.count_if(~good & beyond).alias("bad_out"),
    ).select(stratum, "rule", "k.place", "k.cutoff", "good", "bad", "good_out", "bad_out")
    return certified(counts, stratum, len(rules), risk, error, price)


def apply_rules(docs: DataFrame, cutoffs: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, mark: str = "rejected_by") -> DataFrame:
    """Adds the names of the rules that reject a row, in the order of `rules`."""
    one = cutoffs.groupBy(F.col(stratum).alias("_stratum")).agg(
        *[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"_{r.name}") for r in rules])
    # One row per stratum; Spark broadcasts it where it is small.
    joined = docs.join(one, docs[stratum].eqNullSafe(one["_stratum"]), "left")
    broken = [F.when(r.value() > F.col(f"_{r.name}"), F.lit(r.name)) for r in rules]
    return joined.withColumn(mark, F.array_compact(F.array(*broken))).drop("_stratum", *[f"_{r.name}" for r in rules])


def base_failed(of: str = "measured") -> Column:
    """Too few words, or too many of them in repeated windows."""
    n = F.col(f"{of}.n_words")
    return (n < 10) | (100 * F.col(f"{of}.n_repeat_words") > 20 * n)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """doc_id, the stratum, measured, rejected_by, base_failed, kept for every row."""
    found = cut_lineage(measured(docs, [F.col("doc_id").cast("long").alias("doc_id"), stratum]), "measured")
    # Rows that the base rule rejects are no matter of the rules.
    cutoffs = cut_lineage(fit_rules(found.where(~base_failed()), labels, stratum, **options), "cutoffs")
    ruled = apply_rules(found, cutoffs, stratum, options.get("rules", RULES))
    return ruled.select(
        "doc_id", stratum, "measured", "rejected_by", base_failed().alias("base_failed"),
        (~base_failed() & (F.size("rejected_by") == 0)).alias("kept"),
    )
