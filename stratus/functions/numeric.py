"""Numeric expressions: exact means, shares, deviations, classes, labels,
guarded correlation. Division never raises (ANSI): ``try_divide`` → NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scaled_long(c, scale: int) -> Column:
    """``c`` × 10^scale as an exact integer (the value in units of the last
    decimal), the same integer a cast to DECIMAL(·, scale) holds, in plain
    double/long arithmetic. A value with more decimals than ``scale``, or one
    that is not finite, fails the query with a message instead of being
    rounded silently."""
    units = _c(c).cast(T.DoubleType()) * float(10 ** scale)
    whole = F.rint(units)
    exact = F.abs(units - whole) <= F.lit(1e-3) + F.abs(units) * 1e-12
    return F.when(units.isNull(), F.lit(None).cast(T.LongType())).when(
        F.coalesce(exact, F.lit(False)) & (F.abs(units) < 9.2e18), whole.cast(T.LongType())
    ).otherwise(F.raise_error(F.concat(
        F.lit(f"value has more than {scale} decimals or is not finite: "),
        _c(c).cast("string"))).cast(T.LongType()))


def from_scaled(total: Column, scale: int) -> Column:
    """Integer total in units of 10^-scale → double (same rounding as a
    DECIMAL → DOUBLE cast: integer to double, then one division)."""
    return total.cast(T.DoubleType()) / float(10 ** scale)


def sum_exact(c, scale: int | None = None) -> Column:
    """Aggregate sum. With ``scale`` the values are added as exact integers
    of 10^-scale units, so the result does not depend on addition order —
    i.e. on partitioning or on which engine computes it. ``scale`` must cover
    the decimals present in the data; a total beyond ±9.2e18 units fails
    loudly (ANSI overflow) instead of wrapping. ``None`` keeps plain
    floating-point ``sum``."""
    if scale is None:
        return F.sum(_c(c))
    return from_scaled(F.sum(scaled_long(c, scale)), scale)


def mean_exact(c, scale: int | None = None) -> Column:
    """Aggregate mean; see :func:`sum_exact`. NULLs are skipped, an all-NULL
    group gives NULL."""
    if scale is None:
        return F.avg(_c(c))
    return F.try_divide(sum_exact(c, scale), F.count(_c(c)))


def pct(part, whole, digits: int = 2) -> Column:
    """round(part / whole × 100, digits); NULL when whole is 0 or NULL."""
    return F.round(F.try_divide(_c(part), _c(whole)) * 100, digits)


def deviation(stream, hist, digits: int = 3, zero_as: float | None = None):
    """(absolute, percent) deviation of ``stream`` from ``hist``.

    Percent deviation divides by ``hist``; a zero divisor gives NULL, or
    ``zero_as`` is used as divisor when given (NULL ``hist`` then also takes
    ``zero_as``, but the numerator is NULL anyway)."""
    s, h = _c(stream), _c(hist)
    divisor = h if zero_as is None else F.when(h != 0, h).otherwise(F.lit(float(zero_as)))
    absolute = F.round(s - h, digits)
    percent = F.round(F.try_divide(s - h, divisor) * 100.0, digits)
    return absolute, percent


def rise_pct(value, base, digits: int = 2):
    """Percent by which ``value`` lies over ``base``; NULL unless the base is
    positive."""
    positive = F.when(_c(base) > 0, _c(base))
    return deviation(value, positive, digits)[1]


def circular_gap(a, b, period: float, digits: int = 2) -> Column:
    """Shorter way between two points of a circle of circumference
    ``period``."""
    apart = F.abs(_c(a) - _c(b)) % period
    return F.round(F.least(apart, F.lit(period) - apart), digits)


def deviation_class(diff, threshold: float, labels: Sequence[str]) -> Column:
    """Five-way class of a signed difference, tested in this order:
    < −t, < 0, > t, > 0, otherwise. ``labels`` are the five class names in
    the same order (far below, below, far above, above, at the mean)."""
    d = _c(diff)
    far_below, below, far_above, above, average = labels
    return (F.when(d < -threshold, far_below).when(d < 0, below)
             .when(d > threshold, far_above).when(d > 0, above)
             .otherwise(average))


def label_bucket(bucket, labels: Mapping[int, str]) -> Column:
    """Bucket number → text label (NULL for unknown numbers)."""
    b = _c(bucket)
    expr = None
    for k, text in labels.items():
        expr = F.when(b == k, F.lit(text)) if expr is None else expr.when(b == k, F.lit(text))
    return expr


def flag(predicate: Column) -> Column:
    """Two-valued flag: TRUE when the predicate holds, else FALSE (NULL → FALSE)."""
    return F.when(predicate, F.lit(True)).otherwise(F.lit(False))


def pearson_expr(x, y) -> Column:
    """Pearson r as an aggregate over the rows in which both sides are
    present; NULL (not an error) for constant or empty input:
    covar_pop / (stddev_pop(x) · stddev_pop(y))."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
