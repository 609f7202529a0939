"""The execution model: a tree of phases with data flows between siblings.

Frameworks, applications and stages are few and are linked to each other while they are read, so they are kept on the
driver; tasks can be very many and stay in DataFrames (see sources.spark_log) that take their stage's path by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ROOT = "/"
PHASES = (
    "path string, parent string, name string, tags map<string,string>, type string, start_ns long, end_ns long, depth int, "
    "machine string, is_leaf boolean"
)


class ModelError(ValueError):
    """A change that would break the tree or the flow graph."""


def identifier(name: str, tags: dict[str, str]) -> str:
    return f"{name}[{', '.join(f'{k}={tags[k]}' for k in sorted(tags))}]" if tags else name


@dataclass(eq=False)
class Phase:
    name: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    type_tags: frozenset[str] | None = None  # by default all tags
    start_ns: int = 0
    end_ns: int = 0
    machine: str | None = None
    parent: Phase | None = None
    children: list[Phase] = field(default_factory=list)
    sinks: list[Phase] = field(default_factory=list)
    has_tasks: bool = False  # children that only a DataFrame holds

    @property
    def identifier(self) -> str:
        return identifier(self.name, self.tags)

    @property
    def type_identifier(self) -> str:
        kept = self.tags if self.type_tags is None else {k: v for k, v in self.tags.items() if k in self.type_tags}
        return identifier(self.name, kept)

    def _joined(self, part: str) -> str:
        if self.parent is None:
            return ROOT
        above = self.parent._joined(part)
        return (above if above != ROOT else "") + "/" + getattr(self, part)

    @property
    def path(self) -> str:
        return self._joined("identifier")

    @property
    def type(self) -> str:
        return self._joined("type_identifier")

    @property
    def depth(self) -> int:
        return 0 if self.parent is None else self.parent.depth + 1

    @property
    def duration(self) -> int:
        return max(self.end_ns - self.start_ns, 0)

    def nearest_machine(self) -> str | None:
        return self.machine if self.machine is not None or self.parent is None else self.parent.nearest_machine()

    def ancestors(self) -> Iterator[Phase]:
        """The phase itself and everything above it."""
        phase: Phase | None = self
        while phase is not None:
            yield phase
            phase = phase.parent

    def descendants(self) -> Iterator[Phase]:
        """The phase itself and everything below it."""
        yield self
        for child in self.children:
            yield from child.descendants()


class ExecutionModel:
    def __init__(self) -> None:
        self.root = Phase()

    def add_phase(self, name: str, start_ns: int, end_ns: int, tags: dict[str, str] | None = None, type_tags: set[str] | None = None, machine: str | None = None, parent: Phase | None = None) -> Phase:
        tags = dict(tags or {})
        if type_tags is not None and not set(type_tags) <= set(tags):
            raise ModelError("type tags must be tags")
        phase = Phase(name, tags, None if type_tags is None else frozenset(type_tags), start_ns, end_ns, machine, parent or self.root)
        phase.parent.children.append(phase)
        return phase

    def set_parent(self, phase: Phase, parent: Phase) -> None:
        if phase is self.root or phase in parent.ancestors():
            raise ModelError("a phase cannot be its own ancestor")
        if phase.sinks or any(phase in other.sinks for other in phase.parent.children):
            raise ModelError("a phase with flows keeps its parent")
        phase.parent.children.remove(phase)
        phase.parent = parent
        parent.children.append(phase)

    def add_flow(self, source: Phase, sink: Phase) -> None:
        if source is sink or source.parent is not sink.parent or source.parent is None:
            raise ModelError("flows join different phases of one parent")
        reached, todo = set(), [sink]
        while todo:
            phase = todo.pop()
            if phase is source:
                raise ModelError("flows must not form a cycle")
            if id(phase) not in reached:
                reached.add(id(phase))
                todo += phase.sinks
        if sink not in source.sinks:
            source.sinks.append(sink)

    def close(self) -> None:
        """Give the root the span of its children."""
        self.root.start_ns = min((c.start_ns for c in self.root.children), default=0)
        self.root.end_ns = max((c.end_ns for c in self.root.children), default=0)

    def phases(self) -> list[Phase]:
        return list(self.root.descendants())

    def frame(self, spark: SparkSession) -> DataFrame:
        self.close()
        rows = [
            (p.path, p.parent.path if p.parent else None, p.name, p.tags, p.type, p.start_ns, p.end_ns, p.depth, p.nearest_machine(), not p.children and not p.has_tasks)
            for p in self.phases()
        ]
        return spark.createDataFrame(rows, PHASES)

    def flow_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.path, s.path) for p in self.phases() for s in p.sinks], "source string, sink string")
