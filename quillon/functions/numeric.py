"""Scalar rules shared by the operators: what counts as a number, a ratio, or equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x) -> Column:
    """False for null, NaN and the infinities."""
    x = col(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def finite(x) -> Column:
    """The value, or null unless it is finite."""
    x = col(x).cast("double")
    return F.when(is_finite(x), x)


def coverage_ratio(covered, total) -> Column:
    """covered / total, and 0 where total is 0."""
    covered, total = col(covered).cast("double"), col(total).cast("double")
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(covered, total))


def clamp(x, low, high) -> Column:
    """The value held to its range; null stays null (least and greatest would pass over it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def close_to(x, expected) -> Column:
    """Equal within the larger of 1e-12 and a ten-thousand-millionth of what is expected."""
    expected = col(expected)
    return F.abs(col(x) - expected) <= F.greatest(F.lit(1e-12), F.abs(expected) * 1e-10)


def fraction(text) -> Column:
    """``30000/1001`` or a plain number as a double; null if neither, or over zero."""
    parts = F.split(F.trim(col(text)), "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    bottom = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, F.nullif(bottom, F.lit(0.0))))


def number_field(*fields) -> Column:
    """The first of the fields that is a number or a text of one."""
    return F.coalesce(*[col(f).try_cast("double") for f in fields])


def percent_of(x) -> Column:
    """A progress value as whole percent: up to 1 it is a fraction, else percent; what is no number is 0."""
    x = F.coalesce(finite(x), F.lit(0.0))
    return F.floor(clamp(F.when(x <= 1, x).otherwise(x / 100), 0.0, 1.0) * 100 + 0.5).cast("int")


def eta_ms(elapsed, completed, total, progress) -> Column:
    """Remaining milliseconds by count where a count is known, else by progress of 5 percent at least."""
    elapsed, completed, total, progress = (col(c).cast("double") for c in (elapsed, completed, total, progress))
    by_count = F.when(
        (completed > 0) & (total >= completed), F.try_divide(elapsed, completed) * (total - completed)
    )
    by_progress = F.when(progress >= 5, F.try_divide(elapsed * (100 - progress), progress))
    return F.when(elapsed > 0, F.coalesce(by_count, by_progress))
