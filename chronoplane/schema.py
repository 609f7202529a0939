"""Interval tables: the reserved columns, key columns, and what an operator checks before it is planned."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, DURATION = "_start_time", "_end_time", "_duration"
RESERVED = (START, END, DURATION)

NUMERIC, STRING, BOOLEAN = "NUMERIC", "STRING", "BOOLEAN"
TYPE_OF = {T.DoubleType: NUMERIC, T.StringType: STRING, T.BooleanType: BOOLEAN}


class PlanError(ValueError):
    """A query or operator that cannot be planned."""


def q(name: str) -> str:
    """A column name, dots included, as one quoted name."""
    return "`" + name.replace("`", "``") + "`"


def kind_of(df: DataFrame, name: str) -> str:
    kind = TYPE_OF.get(type(df.schema[name].dataType))
    if kind is None:
        raise PlanError(f"column {name} has type {df.schema[name].dataType.simpleString()}; use double, string or boolean")
    return kind


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise PlanError(f"missing columns: {', '.join(missing)}")


def require_distinct(names: Iterable[str]) -> None:
    twice = [n for n, k in Counter(names).items() if k > 1]
    if twice:
        raise PlanError(f"duplicate columns: {', '.join(twice)}")


def interval_table(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """``df`` with the three reserved columns first: doubles, in seconds; the duration is end less start."""
    rest = [c for c in df.columns if c not in (start, end, *RESERVED)]
    return df.select(
        F.col(q(start)).cast("double").alias(START),
        F.col(q(end)).cast("double").alias(END),
        (F.col(q(end)).cast("double") - F.col(q(start)).cast("double")).alias(DURATION),
        *(F.col(q(c)) for c in rest),
    )
