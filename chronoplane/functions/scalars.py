"""IEEE arithmetic and row-wise functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _nan() -> Column:
    return F.lit(float("nan"))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b on doubles with x/0 infinite and 0/0 not a number, in ANSI mode too; no value where a or b has none."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b != 0, F.try_divide(a, b))
        .when(F.isnan(a) | (a == 0), _nan())
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )


def _either_nan(values: tuple[Column, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.isnan(v) for v in values])


def min_of(*values: Column, kind: str = "NUMERIC") -> Column:
    if kind == "BOOLEAN":
        return reduce(lambda a, b: a & b, values)
    least = F.least(*values)
    return F.when(_either_nan(values), _nan()).otherwise(least) if kind == "NUMERIC" else least


def max_of(*values: Column, kind: str = "NUMERIC") -> Column:
    return reduce(lambda a, b: a | b, values) if kind == "BOOLEAN" else F.greatest(*values)


def as_numeric(flag: Column) -> Column:
    return flag.cast("double")


def equal(a: Column, b: Column, kind: str) -> Column:
    """Equality in which, unlike Spark's, not-a-number equals nothing."""
    return (a == b) & ~F.isnan(a) if kind == "NUMERIC" else a == b
