"""Logs of workflow runs (DAG structure, run ids, task logs), and the training epochs found in them.

Task logs stay tables of lines; what comes to the driver is a row per task, epoch and application.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model.execution import ExecutionModel, Phase
from .files import files_in, is_dir, whole_texts

# Marks in task logs.
CONTEXT = {"dag": "AIRFLOW_CTX_DAG_ID=", "run": "AIRFLOW_CTX_DAG_RUN_ID=", "task": "AIRFLOW_CTX_TASK_ID="}
STARTED, MARKED, TRAINING = "INFO - Executing <Task", "INFO - Marking task", "I tensorflow/"
EPOCH_MARK = "<stdout>:Epoch "


def parse_dag(text: str) -> tuple[list[str], set[tuple[str, str]]]:
    """Task ids in order, and (upstream, downstream) pairs, of a printed tree of ``<Task(kind): id>``.

    A task is downstream of the nearest line above it that is indented less.
    """
    rows = [(len(before), task.rpartition("): ")[2].rstrip(">")) for before, mark, task in (line.partition("<") for line in text.splitlines()) if mark]
    above = (next((up for depth, up in reversed(rows[:i]) if depth < indent), None) for i, (indent, _) in enumerate(rows))
    return list(dict.fromkeys(task for _, task in rows)), {(up, task) for up, (_, task) in zip(above, rows) if up is not None}


def line_time(line: str, zone: str) -> int:
    """Nanoseconds of a line's leading [date time,millis] in a time zone."""
    at = datetime.strptime(line[1 : line.index("]")], "%Y-%m-%d %H:%M:%S,%f").replace(tzinfo=ZoneInfo(zone))
    return int(at.timestamp()) * 1_000_000_000 + at.microsecond * 1_000


@dataclass
class TaskLog:
    file: str
    dag: str
    run: str
    task: str
    start_ns: int
    end_ns: int
    training: bool
    epochs: list[tuple[int, int, int]]  # (number, start, end)


def log_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, n, line, stamp): the lines of whole files with their numbers and what stands in brackets at their start."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return lines.withColumn("stamp", F.regexp_extract("line", r"\A(\[[^\]]*\])", 1))


def read_task_logs(spark: SparkSession, folders: list[str], zone: str) -> tuple[list[TaskLog], DataFrame | None]:
    """A summary of every task log, and the lines of all of them. An epoch lasts from the line that announces it to the
    next INFO line, the last one at most to the end of the log's task."""
    paths = [f for d in folders for f in files_in(spark, f"{d}/logs/airflow", recursive=True) if f.endswith(".log")]
    if not paths:
        return [], None
    lines = log_lines(spark, paths)
    with_mark = lambda mark, value: F.when(F.contains("line", F.lit(mark)), F.struct("n", F.col(value).alias("value")))
    context = [F.min(F.when(F.startswith("line", F.lit(mark)), F.struct("n", F.trim(F.substring("line", len(mark) + 1, 1 << 30)).alias("value"))))["value"].alias(k) for k, mark in CONTEXT.items()]
    tasks = lines.groupBy("file").agg(
        *context, F.min(with_mark(STARTED, "stamp"))["value"].alias("begun"), F.max(with_mark(MARKED, "stamp"))["value"].alias("done"), F.max(F.contains("line", F.lit(TRAINING))).alias("training")
    )
    info = lines.filter((F.col("stamp") != "") & F.contains("line", F.lit(" INFO ")))
    following = info.withColumn("next", F.lead("stamp").over(Window.partitionBy("file").orderBy("n")))
    number = F.regexp_extract(F.substring_index("line", EPOCH_MARK, -1), r"\A([0-9]+)/[0-9]+\s*\z", 1)
    announced = following.filter(F.contains("line", F.lit(EPOCH_MARK))).withColumn("number", number).filter("number <> ''")
    last_of = announced.groupBy("file", "number").agg(F.max(F.struct("n", "stamp", "next")).alias("x")).select("file", F.col("number").cast("int").alias("number"), "x.stamp", "x.next").collect()
    out = []
    for r in sorted(tasks.collect(), key=lambda r: r["file"]):
        missing = [k for k in (*CONTEXT, "begun", "done") if r[k] is None]
        if missing:
            raise ValueError(f"task log {r['file']} lacks {', '.join(missing)}")
        end = line_time(r["done"], zone)
        epochs = [(e["number"], line_time(e["stamp"], zone), line_time(e["next"], zone) if e["next"] else end) for e in last_of if e["file"] == r["file"]]
        out.append(TaskLog(r["file"], r["dag"], r["run"], r["task"], line_time(r["begun"], zone), end, r["training"], sorted(epochs, key=lambda e: (e[1], e[2], e[0]))))
    return out, lines


def add_training_jobs(model: ExecutionModel, logs: list[TaskLog]) -> None:
    """A phase for each task log with training output, its epochs below, chained by flows."""
    for log in logs:
        if log.training:
            job = model.add_phase("TensorFlowJob", log.start_ns, log.end_ns, {"dag": log.dag, "run": log.run, "task": log.task})
            last: Phase | None = None
            for n, start, end in log.epochs:
                epoch = model.add_phase("Epoch", start, end, {"id": str(n)}, set(), parent=job)
                if last is not None:
                    model.add_flow(last, epoch)
                last = epoch


def read_workflow(spark: SparkSession, folders: list[str], model: ExecutionModel, logs: list[TaskLog], lines: DataFrame | None) -> bool:
    """Add workflow runs and their tasks, then hang applications and training jobs below the tasks that ran them."""
    roots = [f"{d}/logs/airflow" for d in folders if is_dir(spark, f"{d}/logs/airflow")]
    if not roots:
        return False
    texts = whole_texts(spark, [f for r in roots for f in files_in(spark, r) if f.endswith((".dag", ".run_ids"))])
    named = lambda suffix: [(p.rpartition("/")[2].removesuffix(suffix), t) for p, t in sorted(texts.items()) if p.endswith(suffix)]
    dags: dict[str, tuple[list[str], set[tuple[str, str]]]] = {}
    for dag, text in named(".dag"):
        tasks, edges = parse_dag(text)
        if dag in dags and ({*dags[dag][0]} != {*tasks} or dags[dag][1] != edges):
            raise ValueError(f"conflicting definitions of DAG {dag!r}")
        dags.setdefault(dag, (tasks, edges))
    if not dags:
        raise ValueError(f"no *.dag file in {', '.join(roots)}")
    runs: dict[str, list[str]] = {}
    for dag, text in named(".run_ids"):
        if dag not in dags:
            raise ValueError(f"run ids of an unknown DAG {dag!r}")
        runs[dag] = list(dict.fromkeys([*runs.get(dag, []), *(x for x in text.splitlines() if x.strip())]))
    for log in logs:
        if log.run not in runs.get(log.dag, []):
            raise ValueError(f"task log of an unknown run {log.run!r} of DAG {log.dag!r}")

    phase_of: dict[tuple[str, str, str], Phase] = {}
    for dag, (_, edges) in dags.items():
        for run in runs.get(dag, []):
            own = [x for x in logs if (x.dag, x.run) == (dag, run)]
            start = min((x.start_ns for x in own), default=min((x.start_ns for x in logs if x.dag == dag), default=0))
            phase = model.add_phase(dag, start, max((x.end_ns for x in own), default=start), {"run_id": run}, set())
            for x in own:
                phase_of[dag, run, x.task] = model.add_phase(x.task, x.start_ns, x.end_ns, parent=phase)
            for up, task in sorted(edges):
                if (dag, run, up) in phase_of and (dag, run, task) in phase_of:
                    model.add_flow(phase_of[dag, run, up], phase_of[dag, run, task])
    if lines is not None:
        link_applications(spark, model, logs, lines, phase_of)
    for job in [p for p in model.root.children if p.name == "TensorFlowJob"]:
        model.set_parent(job, phase_of[job.tags["dag"], job.tags["run"], job.tags["task"]])
        job.tags, job.type_tags = {}, frozenset()
    return True


def link_applications(spark: SparkSession, model: ExecutionModel, logs: list[TaskLog], lines: DataFrame, phase_of: dict[tuple[str, str, str], Phase]) -> None:
    """Applications named in a task log's lines about Spark become children of that task, numbered in the order of ids.

    A name counts where it stands as a whole word. The words of those lines meet the ids in a join.
    """
    phases = {p.tags["id"]: p for p in model.root.children if p.name == "SparkApplication"}
    if not phases:
        return
    apps = spark.createDataFrame([(app,) for app in phases], "app string")
    words = lines.filter(F.lower("line").contains("spark")).select("file", F.explode(F.split("line", r"[^A-Za-z0-9_-]+")).alias("app"))
    named = words.distinct().join(F.broadcast(apps), "app")
    places = named.withColumns({"files": F.count("*").over(Window.partitionBy("app")), "number": F.row_number().over(Window.partitionBy("file").orderBy("app"))})
    task_of = {log.file: (log.dag, log.run, log.task) for log in logs}
    for r in places.collect():
        if r["files"] > 1:
            raise ValueError(f"application {r['app']} is named in more than one task log")
        phase = phases[r["app"]]
        phase.tags, phase.type_tags = {"id": str(r["number"]), "app": r["app"]}, frozenset({"id"})
        model.set_parent(phase, phase_of[task_of[r["file"]]])
