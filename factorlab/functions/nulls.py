"""Null handling shared by every operator: missing is NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL. NaN sorts above infinity, so one comparison does."""
    c = _c(x)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division that yields NULL on a zero denominator, also under ANSI mode."""
    return F.try_divide(_c(num), _c(den))


def masked_last(value: Column | str, order: Column | str) -> Column:
    """Last non-null value by ``order``: nulls are masked out of the ordering key."""
    v = _c(value)
    return F.max_by(v, F.when(v.isNotNull(), _c(order)))


def gated_avg(value: Column | str, window, need: int) -> Column:
    """Moving average that is NULL until ``need`` non-null rows are in the frame."""
    v = _c(value)
    return F.when(F.count(v).over(window) == need, F.avg(v).over(window))
