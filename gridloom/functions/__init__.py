"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Fixed value: standard deviation over median absolute deviation of a normal distribution.
MAD_NORMAL = 1.4826


def amplitude(re: Column, im: Column | None = None) -> Column:
    """Magnitude of a complex or a real value."""
    return F.abs(re.cast("double")) if im is None else F.hypot(re.cast("double"), im.cast("double"))


def median(value: Column) -> Column:
    """Interpolating median that also works over a frame."""
    return F.percentile(value, F.lit(0.5))


def mad_noise(deviation: Column, window: WindowSpec | None = None) -> Column:
    """Scaled median of the non-zero absolute deviations, NULL where there is none; of a group, or over ``window``."""
    size = F.abs(deviation)
    middle = median(F.when(size > 0, size))
    return F.lit(MAD_NORMAL) * (middle if window is None else middle.over(window))


def median_nonzero(value: Column) -> Column:
    return median(F.when(value > 0, value))


def rank_below(value: Column, limit: Column) -> Column:
    """How many values are less than ``limit``."""
    return F.count_if(value < limit)


def zeros(value: Column) -> Column:
    return F.count_if(value == 0)


def fmin(value: Column) -> Column:
    """Minimum that ignores NaN; NaN if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), F.lit(float("nan")))


def fmax(value: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.lit(float("nan")))


def max_below(value: Column, limit: Column) -> Column:
    """Largest non-negative value under ``limit``, 0 without any."""
    return F.greatest(F.coalesce(F.max(F.when(value < limit, value)), F.lit(0)), F.lit(0))


def divup(x: Column | int, y: Column | int):
    """x / y rounded up, for non-negative integers."""
    if isinstance(x, int) and isinstance(y, int):
        return -(-x // y)
    return F.ceil(F.lit(x) / F.lit(y))


def roundup(x: Column | int, y: Column | int):
    """The first multiple of y at or after x."""
    return divup(x, y) * y
