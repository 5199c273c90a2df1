"""Group statistics with one key that holds a third and more of all rows."""

import bisect
import math
import random
import statistics
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from faultline.functions import skew
from faultline.functions.statistics import binomial_tail, sign_test
from faultline.operators.collapse import duplicate_incidents
from faultline.operators.evaluate import query_load
from faultline.operators.pairing import holm


def skewed(seed, n=30_000):
    """Half of all rows on one key, the others on 400 keys."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(400)}", rng.choice(
            [rng.gauss(0, 1), rng.paretovariate(0.3), float(rng.randrange(3)), -5.0]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_median_is_exact_on_skewed_groups(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in skew.exact_median(df, ["k"], "v", "m").collect()}
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_exact_median_handles_nulls_and_null_keys(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 4.0), ("a", None), ("b", 2.0), ("b", None)], "k string, v double"
    )
    got = {r.k: r.m for r in skew.exact_median(df, ["k"], "v", "m").collect()}
    assert got == {None: 2.5, "b": 2.0}


def test_running_functions_equal_one_window(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i, rng.randrange(1000))
            for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    bucketed = df.withColumn("b", F.floor(F.col("at") / 97))
    peak = {
        (r.k, r.at): r.m
        for r in skew.running_max(bucketed, ["k"], "b", ["at"], "v", "m").collect()
    }
    total = {
        (r.k, r.at): r.s
        for r in skew.running_sum(df, ["k"], F.floor(F.col("at") / 97), ["at"], "v", "s").collect()
    }
    rank = {
        (r.k, r.at): r.n
        for r in skew.bucketed_rank(df, ["k"], F.floor(F.col("at") / 97), ["at"], "n").collect()
    }
    state = {}
    for k, at, v in rows:
        high, acc, n = state.get(k, (0, 0, 0))
        state[k] = (max(high, v), acc + v, n + 1)
        assert (peak[k, at], total[k, at], rank[k, at]) == state[k]


def greedy(rows):
    """Sequential reference: cases in id order against all kept cases of their node."""
    kept, flags = {}, {}
    for node, case, start, end in sorted(rows, key=lambda r: r[1]):
        hit = any(start < e and s < end for s, e in kept.get(node, []))
        flags[case] = hit
        if not hit:
            kept.setdefault(node, []).append((start, end))
    return flags


@pytest.mark.parametrize("span", [200_000, 4_000])
def test_duplicate_incidents_equal_the_sequential_rule(spark, span):
    rng = random.Random(span)
    rows = []
    for case in range(1500):
        node = "hot" if rng.random() < 0.6 else f"n{rng.randrange(20)}"
        start = rng.randrange(span)
        rows.append((node, case, start, start + rng.randrange(1, 400)))
    df = spark.createDataFrame(rows, "node string, case_id long, start long, end long")
    marked = duplicate_incidents(df, "node", "case_id", "start", "end", 1000)
    assert {r.case_id: r.duplicate for r in marked.collect()} == greedy(rows)


def test_duplicate_incidents_fixture(spark):
    rows = [("a", "t001", 100, 200), ("a", "t002", 150, 250), ("a", "t003", 300, 400),
            ("b", "t004", 150, 250)]
    df = spark.createDataFrame(rows, "node string, case_id string, start long, end long")
    marked = duplicate_incidents(df, "node", "case_id", "start", "end")
    assert [r.case_id for r in marked.where("duplicate").collect()] == ["t002"]


def python_holm(values, m):
    adjusted, previous = [], 0.0
    order = sorted(range(len(values)), key=lambda i: values[i])
    out = [None] * len(values)
    for rank, i in enumerate(order):
        previous = min(1.0, max(previous, values[i] * (m - rank)))
        out[i] = previous
    # Equal p share the first adjusted value among them.
    return [max(out[j] for j in range(len(values)) if values[j] == values[i]) for i in range(len(values))]


def test_holm_in_one_large_family_with_ties(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0001, 0.0005, 0.002, 0.01, rng.random()]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, p double").withColumn(
        "family", F.lit("f")
    )
    got = {r.i: r.holm_adjusted_p for r in holm(df, ["family"], "p", 500).collect()}
    want = python_holm(values, 500)
    assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in got)


def test_holm_rejects_more_tests_than_declared(spark):
    df = spark.createDataFrame([("f", 0.1), ("f", 0.2)], "family string, p double")
    with pytest.raises(Exception, match="more tests than it declares"):
        holm(df, ["family"], "p", 1).collect()


def exact_p(n, k):
    from fractions import Fraction

    if n > 10**5:  # the ratio of neighbours, from the largest term down, in whole numbers of 2**-200
        term = total = 1 << 200
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            total += term
        log2 = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2) + 1 - n
        return min(1.0, total / 2**200 * 2.0**log2)
    total = sum(math.comb(n, i) for i in range(k + 1))
    return float(min(Fraction(1), Fraction(2 * total, 2**n)))


def test_sign_test_matches_exact_fractions(spark):
    cases = [(0, 0), (1, 0), (7, 1), (13, 0), (5, 7), (10, 1), (2, 7), (50, 30), (500, 500),
             (480, 520), (499, 500), (499, 502), (900, 1100), (1200, 1300), (2500, 2600), (3000, 1000),
             (499_000, 501_000)]
    df = spark.createDataFrame(cases, "neg long, pos long")
    for r in df.select("neg", "pos", sign_test("neg", "pos").alias("p")).collect():
        n, k = r.neg + r.pos, min(r.neg, r.pos)
        if n == 0:
            assert r.p is None
        else:
            assert math.isclose(r.p, exact_p(n, k), rel_tol=1e-9 if n < 10**5 else 1e-7, abs_tol=1e-300), (r, exact_p(n, k))


def decimal_tail(n, k):
    """P(X <= k) of n fair trials in 60 digits: Stirling's series, then the ratio of neighbours."""
    getcontext().prec = 60
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")

    def log_factorial(x):
        x, added = Decimal(x), Decimal(0)
        while x < 60:
            x += 1
            added += x.ln()
        bernoulli = [(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6)]
        series = sum(Decimal(a) / b / (2 * j * (2 * j - 1)) / x ** (2 * j - 1) for j, (a, b) in enumerate(bernoulli, 1))
        return x * x.ln() - x + (2 * pi * x).ln() / 2 + series - added

    term = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * Decimal(2).ln()).exp()
    total = Decimal(0)
    getcontext().prec = 30
    for i in range(k, -1, -1):
        total += term
        term = term * i / (n - i + 1)
        if term < total * Decimal("1e-18"):
            break
    return float(total)


@pytest.mark.parametrize("n", [1, 2, 17, 999, 10**6, 10**9])
def test_binomial_tail_for_any_number_of_trials(spark, n):
    """Memory per row does not depend on n; twelve digits at every n, also beside the mean."""
    ks = sorted({max(0, n // 2 - int(z * math.sqrt(n) / 2)) for z in (4, 8, 30) if n > 10**6 or z < 8} | {0})
    if n <= 10**6:
        ks = sorted({*ks, (n - 1) // 2, max(0, n // 2 - 1), n // 3})
    df = spark.createDataFrame([(k, n) for k in ks], "k long, n long")
    rows = df.select("k", binomial_tail(F.col("k"), F.col("n"), 0.5).alias("low"),
                     binomial_tail(F.col("n") - F.col("k") - 1, F.col("n"), 0.5).alias("high")).collect()
    for r in rows:
        want = decimal_tail(n, r.k)
        assert math.isclose(r.low, want, rel_tol=1e-10, abs_tol=1e-300), (n, r, want)
        assert math.isclose(r.high, 1 - want, rel_tol=1e-10), (n, r, want)


def test_binomial_tail_of_unequal_chances(spark):
    cases = [(k, n, p) for n in (1, 7, 40, 300) for p in (0.01, 0.3, 0.95) for k in {-1, 0, 1, n // 3, n - 1, n} if k <= n]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.select("k", "n", "p", binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("got")).collect():
        p = Fraction(r.p)
        want = float(sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)))
        assert math.isclose(r.got, want, rel_tol=1e-9, abs_tol=1e-15), (r, want)


def test_query_load_concurrency(spark):
    rng = random.Random(3)
    rows = [("s", rng.randrange(5000), rng.randrange(1, 200), 1, False) for _ in range(2000)]
    df = spark.createDataFrame(
        rows, "store string, started long, elapsed long, rows_returned long, failed boolean"
    )
    got = query_load(df, ["store"]).first()
    starts = sorted(r[1] for r in rows)
    ends = sorted(r[1] + r[2] for r in rows)
    peak = max(bisect.bisect_right(starts, s) - bisect.bisect_right(ends, s) for s in starts)
    assert (got.query_count, got.max_concurrency) == (2000, peak)
