"""A session runs statements: built-in tables of a job, views, cached tables, explain, statistics, export."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..analysis.attribution import Attribution
from ..schema import BOOLEAN, DURATION, END, START, PlanError
from ..sources.job import Job
from .expressions import Compiler, names_in
from .language import Select, Statement, parse
from .planner import Planner, Relation, relation

PRINTED = 200


@dataclass
class Result:
    """Rows of a SELECT, lazily: every call runs the query."""

    rel: Relation

    @property
    def df(self) -> DataFrame:
        return self.rel.visible()

    def columns(self) -> list[str]:
        return list(self.rel.kinds)

    def to_map(self) -> dict[str, list]:
        rows = self.rel.df.collect()
        numbered = _numbered(rows, self.rel.series)
        out: dict[str, list] = {"ROW": [r for r, _, _ in numbered], "TS": [s for _, s, _ in numbered]}
        return out | {c: [row[c] for _, _, row in numbered] for c in self.rel.kinds}

    def text(self, most: int = PRINTED) -> str:
        """A table with row and series numbers; of more than ``most`` rows the first and last halves."""
        total = self.rel.df.count()
        if total <= most:
            rows = _numbered(self.rel.df.collect(), self.rel.series)
        else:
            head = _numbered(self.rel.df.limit(most // 2).collect(), self.rel.series)
            tail = self.rel.df.tail(most - most // 2)
            last = head[-1][1] if head else 0
            rows = head + [(total - len(tail) + i + 1, last + s, row) for i, (_, s, row) in enumerate(_numbered(tail, self.rel.series))]
        cells = [["ROW", "TS", *self.rel.kinds]] + [[str(r), str(s), *(shown(row[c]) for c in self.rel.kinds)] for r, s, row in rows]
        widths = [max(len(line[i]) for line in cells) for i in range(len(cells[0]))]
        lines = ["  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in cells]
        if total > most:
            lines.insert(1 + most // 2, "...")
        return "\n".join([*lines, f"{total} rows"])

    __str__ = text


def _numbered(rows: list, series: list[str]) -> list[tuple[int, int, object]]:
    out, number, last = [], 0, object()
    for i, row in enumerate(rows):
        own = tuple(row[s] for s in series)
        number += own != last
        last = own
        out.append((i + 1, number, row))
    return out


def shown(value: object) -> str:
    return str(value).upper() if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


def export_tsv(rel: Relation, path: str | Path) -> int:
    """One file with a header; booleans in capitals, strings in quotes. Rows stream through the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    count = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("\t".join(rel.kinds) + "\n")
        for row in rel.visible().toLocalIterator(prefetchPartitions=True):
            f.write("\t".join(f'"{v}"' if isinstance(v, str) else shown(v) for v in row) + "\n")
            count += 1
    return count


@dataclass
class Session:
    spark: SparkSession
    output: str = "."
    tables: dict[str, Callable[[list], Relation]] = field(default_factory=dict)
    views: dict[str, Select] = field(default_factory=dict)
    plans: dict[str, Relation] = field(default_factory=dict)
    cached: dict[str, Relation] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, keys: Iterable[str]) -> None:
        """A built-in table: double, string and boolean columns, and which of them are keys of its time series."""
        rel = relation(df, set(keys), name)
        self.tables[name] = lambda _, rel=rel: rel

    def register_job(self, job: Job, overrides: DataFrame | None = None, rules: DataFrame | None = None) -> None:
        """The tables phases, metrics and attributed_metrics of a job; ``rules`` saved earlier are not fitted again."""
        self.register("phases", job.phase_table(), ("path", "type"))
        self.register("metrics", job.metric_table(), ("capacity", "path", "type"))
        attribution = Attribution(job.metrics, job.phases, job.aliases, overrides, rules)
        self.tables["attributed_metrics"] = lambda parts: attributed_relation(job, attribution, parts)

    def lookup(self, name: str, parts: list) -> Relation:
        if name in self.cached:
            return self.cached[name]
        if name in self.plans:
            return self.plans[name]
        if name in self.tables:
            return self.tables[name](parts)
        raise PlanError(f"unknown table {name}; there are {', '.join(sorted({*self.tables, *self.plans}))}")

    def plan(self, select: Select, observed: list | None = None) -> Relation:
        return Planner(self.lookup, observed).plan(select)

    def query(self, text: str) -> Result | str:
        """Run exactly one statement."""
        statements = parse(text if text.rstrip().endswith(";") else text + ";")
        if len(statements) != 1:
            raise PlanError(f"one statement is wanted, not {len(statements)}")
        return self.run(statements[0])

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of one SELECT."""
        out = self.query(text)
        if not isinstance(out, Result):
            raise PlanError("only a SELECT has rows")
        return out.df

    def execute(self, text: str) -> str:
        """Run statements and return what they print; an error in the text is returned as text, too."""
        try:
            return "\n".join(str(self.run(s)) for s in parse(text))
        except PlanError as e:
            return f"error: {e}"

    def run(self, s: Statement) -> Result | str:
        if s.kind == "select":
            return Result(self.plan(s.select))
        if s.kind == "create":
            if s.name in self.tables or s.name in self.plans:
                raise PlanError(f"table {s.name} exists")
            self.plans[s.name], self.views[s.name] = self.plan(s.select), s.select
            self.plans[s.name].visible().createOrReplaceTempView(s.name)
            return f"created {s.name}"
        if s.kind == "delete":
            if s.name in self.tables:
                raise PlanError(f"{s.name} is built in")
            self.known(s.name)
            self.uncache(s.name)
            del self.plans[s.name], self.views[s.name]
            self.spark.catalog.dropTempView(s.name)
            return f"deleted {s.name}"
        if s.kind == "cache":
            self.known(s.name)
            if s.name in self.cached:
                return f"{s.name} is cached already"
            rel = self.lookup(s.name, [])
            df = rel.df.persist()
            self.cached[s.name] = Relation(df, rel.kinds, rel.keys, rel.series, [f"ScanTable {s.name} (cached)"])
            row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*rel.series)).alias("series")).first()
            return f"cached {s.name}: {row['series']} time series, {row['rows']} rows"
        if s.kind == "uncache":
            self.known(s.name)
            return f"dropped {s.name} from the cache" if self.uncache(s.name) else f"{s.name} is not cached"
        if s.kind == "explain":
            rel = self.plan(s.select)
            execution = rel.visible()._jdf.queryExecution()
            return "\n".join(["Logical plan:", *rel.tree, "", "Optimized plan:", execution.optimizedPlan().toString(), "Physical plan:", execution.executedPlan().toString()])
        if s.kind == "statistics":
            observed: list = []
            rel = self.plan(s.select, observed)
            rel.df.write.format("noop").mode("overwrite").save()
            return "\n".join(f"{node}: {watch.get['rows']} rows" + (f", about {watch.get['series']} time series" if "series" in watch.get else "") for node, watch in reversed(observed))
        if s.kind == "export":
            path = Path(self.output) / s.name
            return f"exported {export_tsv(self.plan(s.select), path)} rows to {path}"
        raise PlanError(f"unknown statement {s.kind}")

    def known(self, name: str) -> None:
        if name not in self.tables and name not in self.plans:
            raise PlanError(f"unknown table {name}")

    def uncache(self, name: str) -> bool:
        rel = self.cached.pop(name, None)
        if rel is not None:
            rel.df.unpersist()
        return rel is not None


def attributed_relation(job: Job, attribution: Attribution, parts: list) -> Relation:
    """The table attributed_metrics. Conditions on metrics alone are applied before anything is computed, those on
    phases alone before anything is attributed; the others, by the filter above the table."""
    names = ("metric_path", "metric_type"), ("phase_path", "phase_type")
    chosen: list[Column | None] = [None, None]
    for e in parts:
        for i, own in enumerate(names):
            if names_in(e) and names_in(e) <= set(own):
                c, kind = Compiler(dict.fromkeys(own, "STRING"))(e)
                if kind == BOOLEAN:
                    chosen[i] = c if chosen[i] is None else chosen[i] & c
    used = attribution.only(*chosen).attributed()
    types = job.metrics.select("metric_path", "metric_type").distinct()
    phases = job.phases.select(F.col("path").alias("phase_path"), F.col("type").alias("phase_type"))
    rows = used.join(types, "metric_path").join(phases, "phase_path")
    utilization = F.when(F.col("capacity") == 0, 0.0).otherwise(F.col("usage") / F.nullif("capacity", F.lit(0.0)))
    df = rows.select(*job.times(), utilization.alias("utilization"), "usage", "capacity", "metric_path", "metric_type", "phase_path", "phase_type")
    assert df.columns[:3] == [START, END, DURATION]
    return relation(df, {"metric_path", "metric_type", "phase_path", "phase_type"}, "attributed_metrics")
