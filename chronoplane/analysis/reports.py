"""Tables for reports: lists with short ids, run-length series, filters, model trees."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model.execution import ROOT
from ..model.paths import match_tree, split_path
from ..operators.intervals import active_count, step_sums
from ..storage import written


def numbered(df: DataFrame, path: str, prefix: str) -> DataFrame:
    """(path, id): short ids in the order of a walk down the tree, padded with zeros.

    Distinct paths are sorted by range and numbered within each range from the sizes of those before; the sorted table
    is written, as its numbers are used more than once. No path reaches the driver.
    """
    paths = df.select(F.col(path).alias("path")).distinct().withColumn("parts", F.split("path", "/"))
    ordered = paths.repartitionByRange((F.col("path") != ROOT).alias("below"), "parts").sortWithinPartitions(F.col("path") != ROOT, "parts")
    placed = written(ordered.select("path", F.monotonically_increasing_id().alias("place")), "numbered").withColumn("range", F.shiftright("place", 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"), F.length((F.sum("n").over(Window.partitionBy()) - 1).cast("string")).alias("width"))
    number = (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).cast("string")
    return placed.join(F.broadcast(before), "range").select("path", F.concat(F.lit(prefix), F.lpad(number, F.col("width"), F.lit("0"))).alias("id"))


def _with_id(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """df with the ids of the paths in a column; none where the path is null."""
    return df.join(ids.select(F.col("path").alias(column), F.col("id").alias(name)), column, "left")


def metric_list(metrics: DataFrame) -> DataFrame:
    rows = metrics.groupBy("metric_path").agg(F.max("max_value").alias("max.value"))
    return _with_id(rows, "metric_path", numbered(metrics, "metric_path", "m"), "metric.id").select("`metric.id`", F.col("metric_path").alias("metric.path"), "`max.value`").orderBy("`metric.id`")


def phase_list(phases: DataFrame) -> DataFrame:
    ids = numbered(phases, "path", "p")
    place = Window.partitionBy("parent").orderBy("start_ns", "path")
    rows = _with_id(_with_id(phases.withColumn("canonical.index", F.row_number().over(place) - 1), "path", ids, "phase.id"), "parent", ids, "parent.phase.id")
    return rows.select(
        "`phase.id`", F.col("path").alias("phase.path"), F.coalesce("`parent.phase.id`", F.lit("")).alias("parent.phase.id"), "depth", F.col("start_ns").alias("start.time.ns"), F.col("end_ns").alias("end.time.ns"), "`canonical.index`"
    ).orderBy("`phase.id`")


def phase_type_list(phases: DataFrame) -> DataFrame:
    ids = numbered(phases, "type", "pt")
    above = F.when(F.col("type") == ROOT, F.lit(None)).otherwise(F.coalesce(F.nullif(F.regexp_extract("type", r"(?s)\A(.*)/(?:[^/\[]|\[[^\]]*\])+\z", 1), F.lit("")), F.lit(ROOT)))
    types = phases.groupBy("type").agg(F.min("depth").alias("depth"), F.min("start_ns").alias("first")).withColumn("above", above)
    place = Window.partitionBy("above").orderBy("first", "type")
    rows = _with_id(_with_id(types.withColumn("canonical.index", F.row_number().over(place) - 1), "type", ids, "phase.type.id"), "above", ids, "parent.phase.type.id")
    return rows.select("`phase.type.id`", F.col("type").alias("phase.type.path"), F.coalesce("`parent.phase.type.id`", F.lit("")).alias("parent.phase.type.id"), "depth", "`canonical.index`").orderBy("`phase.type.id`")


def run_length(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, timestamp, value): a row where the value changes, and a closing row at the end of the series."""
    order = Window.partitionBy(*keys).orderBy("start_ns")
    changed = series.withColumns({"last": F.lag(value).over(order), "end": F.max("end_ns").over(Window.partitionBy(*keys)), "again": F.row_number().over(order) > 1})
    changed = changed.filter(~F.col("again") | ~F.col("last").eqNullSafe(F.col(value)))
    closing = series.groupBy(*keys).agg(F.max("end_ns").alias("timestamp"), F.max_by(value, "start_ns").alias(value))
    return changed.select(*keys, F.col("start_ns").alias("timestamp"), value).unionByName(closing)


def metric_data(metrics: DataFrame) -> DataFrame:
    rows = run_length(metrics.select("metric_path", "start_ns", "end_ns", "value"), ["metric_path"])
    return _with_id(rows, "metric_path", numbered(metrics, "metric_path", "m"), "metric.id").select("`metric.id`", "timestamp", "value")


def attribution_data(attributed: DataFrame, metrics: DataFrame, phases: DataFrame) -> DataFrame:
    rows = run_length(attributed.select("metric_path", "phase_path", "start_ns", "end_ns", F.col("usage").alias("value")), ["metric_path", "phase_path"])
    rows = _with_id(rows, "metric_path", numbered(metrics, "metric_path", "m"), "metric.id")
    return _with_id(rows, "phase_path", numbered(phases, "path", "p"), "phase.id").select("`metric.id`", "`phase.id`", "timestamp", "value")


def aggregate_attribution(attributed: DataFrame, phases: DataFrame) -> DataFrame:
    """(metric_path, phase_type, start_ns, end_ns, value, count): usage summed over the active phases of each type."""
    rows = attributed.join(phases.select(F.col("path").alias("phase_path"), F.col("type").alias("phase_type")), "phase_path")
    rows = written(rows.select("metric_path", "phase_type", "start_ns", "end_ns", F.col("usage").alias("value"), F.lit(1).alias("count")), "by-type")
    sums = step_sums(rows, ["value", "count"], ["metric_path", "phase_type"], "start_ns", "end_ns", eager=True)
    return sums.filter("count > 0").withColumn("count", F.col("count").cast("long"))


def aggregate_attribution_data(attributed: DataFrame, metrics: DataFrame, phases: DataFrame) -> DataFrame:
    """The aggregate series as rows where the usage or the number of active phases changes."""
    sums = aggregate_attribution(attributed, phases).withColumn("both", F.struct("value", "count"))
    rows = run_length(sums, ["metric_path", "phase_type"], "both")
    rows = _with_id(rows, "metric_path", numbered(metrics, "metric_path", "m"), "metric.id")
    return _with_id(rows, "phase_type", numbered(phases, "type", "pt"), "phase.type.id").select("`metric.id`", "`phase.type.id`", "timestamp", "both.value", "both.count")


def write_tables(folder: str | Path, metrics: DataFrame, phases: DataFrame, upsampled: DataFrame | None = None, attributed: DataFrame | None = None) -> list[str]:
    """Write the report files, tab separated with a header, and return their names. Rows stream through the driver."""
    tables = {"metric-list.tsv": metric_list(metrics), "phase-list.tsv": phase_list(phases), "phase-type-list.tsv": phase_type_list(phases), "metric-data.tsv": metric_data(metrics)}
    if upsampled is not None:
        tables["upsampled-metric-data.tsv"] = metric_data(upsampled)
    if attributed is not None:
        tables["resource-attribution-data.tsv"] = attribution_data(attributed, metrics, phases)
        tables["aggregate-resource-attribution-data.tsv"] = aggregate_attribution_data(attributed, metrics, phases)
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, df in tables.items():
        with open(Path(folder) / name, "w", encoding="utf-8") as f:
            f.write("\t".join(df.columns) + "\n")
            f.writelines("\t".join(map(str, row)) + "\n" for row in df.toLocalIterator(prefetchPartitions=True))
    return list(tables)


def active_phases(phases: DataFrame, kind: str | None = None) -> DataFrame:
    """How many phases (of a type) are active over time."""
    chosen = phases if kind is None else phases.filter(F.col("type") == kind)
    return active_count(chosen, [], "start_ns", "end_ns")


def filtered_phases(paths: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Paths selected by expressions: what is included keeps its ancestors, what is excluded takes its descendants."""
    below = lambda p, a: p == a or p.startswith(a.rstrip("/") + "/")
    kept = set(paths)
    if include:
        wanted = {p for e in include for p in match_tree(paths, e)}
        kept = {p for p in paths if any(below(w, p) for w in wanted)}
    gone = {p for e in exclude for p in match_tree(paths, e)}
    return [p for p in paths if p in kept and not any(below(p, g) for g in gone)]


def filtered_resources(paths: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Resources selected like phases: what is included keeps its ancestors, what is excluded takes its descendants."""
    return filtered_phases(paths, include, exclude)


def resources_of(metrics: DataFrame) -> list[str]:
    """Every resource that has a metric, and those above it."""
    own = {r[0] for r in metrics.select(F.substring_index("metric_path", ":", 1)).distinct().collect()}
    above = {"/" + "/".join(parts[:n]) for parts in map(split_path, own) for n in range(len(parts) + 1)}
    return sorted(above, key=split_path)


def visible_metrics(metrics: list[str], resources: list[str]) -> list[str]:
    """Metrics whose resource is visible."""
    seen = set(resources)
    return [m for m in metrics if m.rpartition(":")[0] in seen]


def resource_tree_text(metrics: list[str], resources: list[str], depth: int | None = None) -> str:
    """The tree of visible resources, each followed by its metrics."""
    shown = {}
    for m in visible_metrics(metrics, resources):
        shown.setdefault(m.rpartition(":")[0], []).append(m.rpartition(":")[2])
    lines = []
    for p in sorted(set(resources), key=split_path):
        parts = split_path(p)
        if depth is None or len(parts) <= depth:
            lines.append("  " * len(parts) + (parts[-1] if parts else ROOT))
            lines += ["  " * (len(parts) + 1) + ":" + m for m in sorted(shown.get(p, []))]
    return "\n".join(lines)


def tree_text(paths: list[str], depth: int | None = None, short: bool = False) -> str:
    """An indented tree of paths down to a depth; ``short`` prints only the last component."""
    lines = []
    for p in sorted(set(paths), key=lambda x: split_path(x)):
        parts = split_path(p)
        if depth is None or len(parts) <= depth:
            lines.append("  " * len(parts) + (p if not short else (parts[-1] if parts else ROOT)))
    return "\n".join(lines)
