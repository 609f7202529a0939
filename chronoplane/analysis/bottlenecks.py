"""Bottlenecks: how much shorter a phase could be without waiting for a group of metrics.

In every stretch of time the metrics of a group count by their largest share of capacity in use. Removing a group gains
at most its share, and no more than the other groups leave room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import tiled

GROUPINGS: dict[str, Column | str] = {"metric": "metric_path", "resource": "metric_path", "metric_type": "metric_type", "resource_type": "metric_type"}


def group_of(grouping: str) -> Column:
    if grouping not in GROUPINGS:
        raise ValueError(f"grouping must be one of {', '.join(GROUPINGS)}")
    column = F.col(GROUPINGS[grouping])
    return F.substring_index(column, ":", 1) if grouping.startswith("resource") else column


def bottlenecks(attributed: DataFrame, grouping: str = "metric") -> DataFrame:
    """(phase_path, group, duration_without_overhead, duration_without_group, duration_without_group_and_overhead), in ns.

    ``attributed``: (metric_path, phase_path, start_ns, end_ns, usage, capacity) and metric_type where it is grouped by.
    A capacity of 0 counts as full use. Phases without attributed metrics have no rows.
    """
    used = F.when(F.col("capacity") > 0, F.least(F.col("usage") / F.col("capacity"), F.lit(1.0))).otherwise(1.0)
    rows = attributed.filter("start_ns < end_ns").select("phase_path", group_of(grouping).alias("group"), "start_ns", "end_ns", used.alias("f"))
    parts = tiled(rows, ["phase_path"], {"f": (F.col("f"), F.max)}, "start_ns", "end_ns", within=["group"])
    stretch = Window.partitionBy("phase_path", "__s", "__e")
    ranked = parts.withColumns(
        {
            "total": F.least(F.sum("f").over(stretch), F.lit(1.0)),
            "first": F.max("f").over(stretch),
            "place": F.row_number().over(stretch.orderBy(F.desc("f"), "group")),
        }
    )
    ranked = ranked.withColumn("second", F.coalesce(F.max(F.when(F.col("place") == 2, F.col("f"))).over(stretch), F.lit(0.0)))
    # The largest other share: of two groups with equal largest shares it is that same share.
    second = F.coalesce(F.max(F.when(F.col("f") < F.col("first"), F.col("f"))).over(stretch), F.lit(0.0))
    ranked = ranked.withColumn("second", F.greatest("second", second))
    other = F.when(F.col("f") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    gain = F.least(F.col("f"), 1.0 - other)
    d = (F.col("__e") - F.col("__s")).cast("double")
    # A group without a value in a stretch has share 0 there and gains nothing.
    span = ranked.filter("place = 1").groupBy("phase_path").agg(F.sum(d).alias("span"), F.sum(d * F.col("total")).alias("busy"))
    gained = ranked.groupBy("phase_path", "group").agg(F.sum(d * gain).alias("gain"))
    return gained.join(span, "phase_path").select(
        "phase_path", "group", F.col("busy").alias("duration_without_overhead"), (F.col("span") - F.col("gain")).alias("duration_without_group"), (F.col("busy") - F.col("gain")).alias("duration_without_group_and_overhead")
    )


def report(found: DataFrame, phases: DataFrame) -> DataFrame:
    """Each group's impact on its phase: what remains without it, and the savings in percent, largest first."""
    with_span = found.join(phases.select(F.col("path").alias("phase_path"), (F.col("end_ns") - F.col("start_ns")).cast("double").alias("observed")), "phase_path")
    impact = F.col("observed") - F.col("duration_without_group")
    net = F.col("duration_without_overhead") - F.col("duration_without_group_and_overhead")
    percent = lambda part, whole: F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
    return with_span.select(
        "phase_path", "group", "observed", F.col("duration_without_group").alias("remaining"), impact.alias("impact"), percent(impact, F.col("observed")).alias("percent_of_observed"),
        percent(net, F.col("duration_without_overhead")).alias("percent_without_overhead"),
    ).orderBy("phase_path", "remaining", "group")
