"""Column expressions for incident windows and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (
        value if isinstance(value, Column) else F.lit(value)
    )


def floor_div(value, width: int) -> Column:
    """Whole-number division toward minus infinity.

    Stays in 64-bit integers: a double cannot hold a nanosecond timestamp.
    """
    v = _c(value).cast("bigint")
    return F.call_function("div", v - F.pmod(v, F.lit(width)), F.lit(width).cast("bigint"))


def half_open(ts, start, end) -> Column:
    """C1. `start <= ts < end`; use it on the raw column so that the scan can skip row groups."""
    return (_c(ts) >= _c(start)) & (_c(ts) < _c(end))


def closed(ts, start, end, scale: int = 1) -> Column:
    """C2. Both ends included; bounds in seconds, `scale` units per second."""
    low, high = _c(start).cast("bigint"), _c(end).cast("bigint")
    return _c(ts).between(low * F.lit(scale), high * F.lit(scale))


def floor_to(value, width: int) -> Column:
    """C7. Start of the bucket of `width` units that holds the value."""
    v = _c(value)
    return v - F.pmod(v, F.lit(width))


def minute_envelope(start, end) -> tuple[Column, Column]:
    """C3. Smallest whole-minute window around `[start, end)`, in seconds."""
    e = _c(end)
    return floor_to(start, 60), e + F.pmod(-e, F.lit(60))


def server_scan(start, end, before: int = 300, after: int = 3600) -> tuple[Column, Column]:
    """C3. Range in which a server span of the window may start, in seconds."""
    return _c(start) - F.lit(before), _c(end) + F.lit(after)


def period_by_boundary(ts, boundary) -> Column:
    """C4."""
    return F.when(_c(ts) < _c(boundary), "normal").otherwise("abnormal")


def period_of(ts, normal_start, boundary, abnormal_end) -> Column:
    """C5. Null outside of both windows."""
    return F.when(half_open(ts, normal_start, boundary), "normal").when(
        half_open(ts, boundary, abnormal_end), "abnormal"
    )


def bucket_period(start, width, normal_start, boundary, abnormal_end) -> Column:
    """C6. Period of a whole bucket, null when it straddles a bound."""
    first = period_of(start, normal_start, boundary, abnormal_end)
    last = period_of(_c(start) + _c(width) - F.lit(1), normal_start, boundary, abnormal_end)
    return F.when(first == last, first)


def baseline_window(alert, end) -> tuple[Column, Column]:
    """C8. The window of equal length right before the alert."""
    return _c(alert) - (_c(end) - _c(alert)), _c(alert)


def time_coverage(lo_op, lo, hi_op, hi, normal_start, boundary, abnormal_end):
    """C9. Periods a submitted time range touches, and those it covers completely.

    Operators are `gte`/`gt` and `lt`/`lte`, bounds are epoch seconds. Returns
    two arrays, null when the range is rejected: a bound is missing, the range
    is empty, or it reaches over a period without covering both.
    """
    low, high = _c(lo), _c(hi)
    n0, n1, a1 = _c(normal_start), _c(boundary), _c(abnormal_end)
    usable = _c(lo_op).isin("gte", "gt") & _c(hi_op).isin("lt", "lte") & (low < high)
    inclusive = _c(lo_op) == "gte"
    both = usable & inclusive & (low == n0) & (high == a1)
    in_normal = usable & (low >= n0) & (high <= n1)
    in_abnormal = usable & (low >= n1) & (high <= a1)
    pair = F.array(F.lit("abnormal"), F.lit("normal"))
    normal, abnormal = F.array(F.lit("normal")), F.array(F.lit("abnormal"))
    none = F.array().cast("array<string>")
    periods = F.when(both, pair).when(in_normal, normal).when(in_abnormal, abnormal)
    complete = (
        F.when(both, pair)
        .when(in_normal & inclusive & (low == n0) & (high == n1), normal)
        .when(in_abnormal & inclusive & (low == n1) & (high == a1), abnormal)
        .when(in_normal | in_abnormal, none)
    )
    return periods, complete


def unfiltered_coverage(lo_op, lo, hi_op, hi, normal_start, abnormal_end) -> Column:
    """C9. Row listings: no bound at all, or a range around both periods, covers them."""
    low, high = _c(lo), _c(hi)
    before = (low < _c(normal_start)) | ((low == _c(normal_start)) & (_c(lo_op) == "gte"))
    after = (high > _c(abnormal_end)) | (
        (high == _c(abnormal_end)) & _c(hi_op).isin("lt", "lte")
    )
    return F.when(low.isNull() & high.isNull(), F.lit(True)).otherwise(
        F.coalesce(before & after, F.lit(False))
    )


def context(start, end, alert, injected) -> dict[str, Column]:
    """C14. What is known about the time axis of a case; null = not known."""
    s, e, a, i = _c(start), _c(end), _c(alert), _c(injected)
    window = s.isNotNull() & e.isNotNull() & (s <= e)
    known = F.coalesce(window & (i >= s) & (i <= e), F.lit(False))
    return {
        "window_seconds": F.when(window, e - s),
        "telemetry_before_alert_seconds": F.when(
            window & a.isNotNull(), F.greatest(F.lit(0), F.least(a, e) - s)
        ),
        "known_pre_fault_seconds": F.when(known, i - s),
        "known_post_fault_seconds": F.when(known, e - i),
        "baseline_status": F.when(known, F.lit("known")).otherwise(F.lit("unknown")),
    }
