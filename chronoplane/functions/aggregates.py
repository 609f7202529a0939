"""Aggregates over interval rows. ``order`` stands for the order of input rows: series, then start, then end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ieee_div


def count() -> Column:
    return F.count(F.lit(1)).cast("double")


def count_if(flag: Column) -> Column:
    return F.count_if(flag).cast("double")


def minimum(value: Column, kind: str = "NUMERIC") -> Column:
    """For numbers, not-a-number wins, as in IEEE minima."""
    low = F.min(value)
    return F.when(F.max(F.isnan(value)), F.lit(float("nan"))).otherwise(low) if kind == "NUMERIC" else low


def maximum(value: Column, kind: str = "NUMERIC") -> Column:
    return F.max(value)


def total(value: Column) -> Column:
    return F.sum(value)


def average(value: Column) -> Column:
    return F.avg(value)


def weighted_average(value: Column, weight: Column) -> Column:
    return ieee_div(F.sum(value * weight), F.sum(weight))


def average_over_time(value: Column, start: Column, end: Column) -> Column:
    return weighted_average(value, end - start)


def first_value(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def find_or_default(flag: Column, value: Column, default: Column, order: Column) -> Column:
    """``value`` on the first row with ``flag``, else ``default`` on the first row."""
    return F.coalesce(F.min_by(value, F.when(flag, order)), F.min_by(default, order))
