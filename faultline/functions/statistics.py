"""Column expressions for paired statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_factorial(n: Column) -> Column:
    """ln(n!) by the Stirling series at n + 11, and the factors in between divided out."""
    x = n.cast("double") + 11.0
    series = (
        (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + 1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x, F.lit(3.0)))
        + 1.0 / (1260.0 * F.pow(x, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(x, F.lit(7.0)))
    )
    factors = F.lit(1.0)
    for i in range(1, 11):
        factors = factors * (n.cast("double") + float(i))
    return series - F.log(factors)


def _stirling_error(n: Column) -> Column:
    """ln(n!) less Stirling's formula without its series; n is positive."""
    x = n.cast("double")
    series = (
        1.0 / (12.0 * x) - 1.0 / (360.0 * F.pow(x, F.lit(3.0)))
        + 1.0 / (1260.0 * F.pow(x, F.lit(5.0))) - 1.0 / (1680.0 * F.pow(x, F.lit(7.0)))
    )
    formula = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi))
    return F.when(x >= 16, series).otherwise(_log_factorial(n) - formula)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without cancellation near the mean."""
    off = (x - mean) / mean
    return mean * ((1.0 + off) * F.log1p(off) - off)


#: Levels of the continued fraction. Near the mean of n observations about a tenth of sqrt(n) are needed.
MOST_LEVELS = 5000


def _lower_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for k below the mean: the term at k times the incomplete beta's continued fraction."""
    a, b, x = (n - k).cast("double"), k.cast("double") + 1.0, 1.0 - p
    rest = (n - k).cast("double")
    whole = n.cast("double")
    term = F.when(k == 0, F.exp(whole * F.log1p(-p))).otherwise(
        F.sqrt(whole / (2 * math.pi * k.cast("double") * rest))
        * F.exp(
            _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
            - _deviance(k.cast("double"), whole * p) - _deviance(rest, whole * x)
        )
    )

    def level(below: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        return 1.0 + even / (1.0 + odd / below)

    # From the innermost level outwards; it ends by itself at level b.
    levels = F.least(F.lit(MOST_LEVELS), F.ceil(F.sqrt(whole)) + 40, k + 1).cast("int")
    inner = F.aggregate(F.sequence(levels, F.lit(1), F.lit(-1)), F.lit(1.0), level)
    return term * p / (1.0 - (a + b) * x / (a + 1.0) / inner)


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(X <= k) of n trials with 0 < p < 1, exact to about twelve digits for any n.

    Memory does not grow with n: a continued fraction of at most `MOST_LEVELS` levels.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    p = F.lit(p) if isinstance(p, float) else p
    low = (k.cast("double") + 1.0) <= p * (n.cast("double") + 1.0)
    other = F.lit(1.0) - _lower_tail(n - k - 1, n, 1.0 - p)
    return F.when(k < 0, 0.0).when(k >= n, 1.0).when(low, _lower_tail(k, n, p)).otherwise(other)


def sign_test(negative: Column | str, positive: Column | str) -> Column:
    """F62. Exact two-sided sign test; ties are already dropped, null without observations."""
    neg = F.col(negative) if isinstance(negative, str) else negative
    pos = F.col(positive) if isinstance(positive, str) else positive
    n = (neg + pos).cast("bigint")
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * binomial_tail(F.least(neg, pos), n, 0.5)))


def null_strict_sum(value: Column | str) -> Column:
    """F56. Sum that is null as soon as one input is null, or when there is none."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def relative_change(delta: Column, baseline: Column) -> Column:
    """F59. Null without a scale to divide by."""
    return F.when(baseline != 0, delta / baseline)


def only_value(value: Column | str) -> Column:
    """The one distinct value of a group, null for none, several or a missing one."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(
        (F.count(v) == F.count(F.lit(1))) & (F.min(v) == F.max(v)), F.min(v)
    )
