"""A whole job: all sources read in order into phases and metrics tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.execution import ExecutionModel
from ..schema import DURATION, END, START
from .hosts import read_hosts
from .monitor import read_monitor
from .spark_log import SparkLogs, read_spark_logs, task_phases
from .workflow_logs import add_training_jobs, read_task_logs, read_workflow

METRICS = "metric_path string, metric_type string, machine string, start_ns long, end_ns long, value double, max_value double"
NS = 1e9


@dataclass
class Job:
    """phases and metrics: times in nanoseconds; aliases: machine name -> canonical name."""

    spark: SparkSession
    model: ExecutionModel
    phases: DataFrame
    metrics: DataFrame
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def start_ns(self) -> int:
        return self.model.root.start_ns

    def seconds(self, ns: str):
        return (F.col(ns) - F.lit(self.start_ns)) / F.lit(NS)

    def times(self) -> list:
        return [self.seconds("start_ns").alias(START), self.seconds("end_ns").alias(END), ((F.col("end_ns") - F.col("start_ns")) / F.lit(NS)).alias(DURATION)]

    def phase_table(self) -> DataFrame:
        """The table ``phases``: a row per phase, the root too."""
        return self.phases.select(*self.times(), "path", "type")

    def metric_table(self) -> DataFrame:
        """The table ``metrics``: a row per measurement."""
        from ..functions.scalars import ieee_div

        return self.metrics.select(
            *self.times(), ieee_div(F.col("value"), F.col("max_value")).alias("utilization"), F.col("value").alias("usage"), F.col("max_value").alias("capacity"),
            F.col("metric_path").alias("path"), F.col("metric_type").alias("type"),
        )


#: Further readers: each is called with (spark, folders, model) and may return a metrics table.
EXTRA_SOURCES: list[Callable[[SparkSession, list[str], ExecutionModel], DataFrame | None]] = []


def register_source(reader: Callable[[SparkSession, list[str], ExecutionModel], DataFrame | None]) -> None:
    EXTRA_SOURCES.append(reader)


def read_job(spark: SparkSession, folders: list[str] | str, zone: str = "UTC") -> Job:
    """Read job folders: hosts, monitor files, event logs, training logs, workflow logs (last, as they relink)."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    model = ExecutionModel()
    aliases = read_hosts(spark, folders)
    metrics = read_monitor(spark, folders)
    logs: SparkLogs | None = read_spark_logs(spark, folders, model)
    task_logs, lines = read_task_logs(spark, folders, zone)
    add_training_jobs(model, task_logs)
    read_workflow(spark, folders, model, task_logs, lines)
    for reader in EXTRA_SOURCES:
        more = reader(spark, folders, model)
        if more is not None:
            metrics = more if metrics is None else metrics.unionByName(more)
    metrics = spark.createDataFrame([], METRICS) if metrics is None else metrics
    if not model.root.children:
        span = metrics.agg(F.min("start_ns").alias("a"), F.max("end_ns").alias("b")).first()
        if span["a"] is not None:  # no phase at all: one that spans the metrics
            model.add_phase("dummy_phase", span["a"], span["b"])
    if logs is not None:
        with_tasks = {(r["app"], r["stage"], r["stage_attempt"]) for r in logs.tasks.select("app", "stage", "stage_attempt").distinct().collect()}
        for key, phase in logs.stages.items():
            phase.has_tasks = key in with_tasks
    phases = model.frame(spark)
    if logs is not None and logs.stages:
        phases = phases.unionByName(task_phases(logs))
    return Job(spark, model, phases, metrics, aliases)
