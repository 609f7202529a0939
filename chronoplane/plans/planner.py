"""From SELECT statements to DataFrames.

A relation is a DataFrame with the visible columns, the keys among them, and hidden columns that tell which time
series a row belongs to. Series survive projection, so merging of intervals never crosses them even where the columns
that distinguish them are not selected. Everything else (pruning, pushing filters and computed columns, choosing
joins) is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import coalesce_intervals, overlap_sums, sliced, temporal_counts, temporal_join, tiled
from ..schema import BOOLEAN, DURATION, END, NUMERIC, RESERVED, START, PlanError, kind_of, q, require_distinct
from .expressions import Compiler, conjuncts, has_aggregate, names_in
from .language import Binary, Call, Literal, Name, Select, Star, Unary, show


@dataclass
class Relation:
    df: DataFrame
    kinds: dict[str, str]  # visible columns in order, with their types
    keys: set[str] = field(default_factory=set)
    series: list[str] = field(default_factory=list)  # hidden columns
    tree: list[str] = field(default_factory=list)  # the logical plan, root first

    def step(self, text: str) -> list[str]:
        return [text, *("  " + line for line in self.tree)]

    def visible(self) -> DataFrame:
        return self.df.select(*(F.col(q(c)) for c in self.kinds))


def relation(df: DataFrame, keys: set[str] | list[str], name: str = "table") -> Relation:
    """A table as a relation: its series are told apart by all its key columns."""
    kinds = {c: kind_of(df, c) for c in df.columns}
    keys = set(keys)
    hidden = F.struct(*(F.col(q(k)) for k in df.columns if k in keys)) if keys else F.lit(0)
    return Relation(df.withColumn("__s0", hidden), kinds, keys, ["__s0"], [f"ScanTable {name}"])


def unprefixed(e: object, alias: str) -> object:
    """An expression as it reads without an alias; names of other tables stay and match nothing there."""
    if isinstance(e, Name):
        return Name(e.path.removeprefix(alias + ".")) if e.path.startswith(alias + ".") else Name("?" + e.path)
    if isinstance(e, Call):
        return Call(e.function, tuple(unprefixed(a, alias) for a in e.args))
    if isinstance(e, Unary):
        return Unary(e.op, unprefixed(e.arg, alias))
    return Binary(e.op, unprefixed(e.left, alias), unprefixed(e.right, alias)) if isinstance(e, Binary) else e


def linear(e: object, typing: Compiler, own: list[set[str]]) -> tuple[Column | None, Column | None, float, float, float] | None:
    """f, g, a, b, c of an expression that is f + g + a * _start_time + b * _end_time + c, with f and g of columns of one side
    each; None if it is not of this form."""
    names = names_in(e)
    if names:
        for k, side in enumerate(own):
            if names <= side:
                c = typing.typed(e, NUMERIC, False)
                return (c, None, 0.0, 0.0, 0.0) if k == 0 else (None, c, 0.0, 0.0, 0.0)
    if isinstance(e, Literal):
        return (None, None, 0.0, 0.0, float(e.value)) if isinstance(e.value, (int, float)) and not isinstance(e.value, bool) else None
    if isinstance(e, Name):
        return {START: (None, None, 1.0, 0.0, 0.0), END: (None, None, 0.0, 1.0, 0.0), DURATION: (None, None, -1.0, 1.0, 0.0)}.get(e.path)
    if isinstance(e, Unary) and e.op == "-":
        found = linear(e.arg, typing, own)
        return None if found is None else (*(None if c is None else -c for c in found[:2]), *(-x for x in found[2:]))
    if not isinstance(e, Binary) or e.op not in ("+", "-", "*", "/"):
        return None
    x, y = linear(e.left, typing, own), linear(e.right, typing, own)
    if x is None or y is None:
        return None
    if e.op in ("+", "-"):
        sign = 1.0 if e.op == "+" else -1.0
        both = [p if r is None else (r if sign > 0 else -r) if p is None else p + r if sign > 0 else p - r for p, r in zip(x[:2], y[:2], strict=True)]
        return (*both, *(p + sign * r for p, r in zip(x[2:], y[2:], strict=True)))
    if e.op == "*" and not names_in(e.left):
        x, y = y, x
    if y[:4] != (None, None, 0.0, 0.0) or names_in(e.left) and names_in(e.right) or e.op == "/" and y[4] == 0:
        return None
    by = y[4]
    return (*(None if c is None else c * F.lit(by) if e.op == "*" else c / F.lit(by) for c in x[:2]), *(p * by if e.op == "*" else p / by for p in x[2:]))


@dataclass
class Planner:
    """lookup: gives the relation of a table name, and may use the conditions given with it to compute less of it."""

    lookup: Callable[[str, list], Relation]
    observed: list[tuple[str, object]] | None = None  # (node, Observation) where statistics are asked for

    def plan(self, s: Select) -> Relation:
        inputs = [self.source(x.table, x.alias, len(s.sources) > 1, s) for x in s.sources]
        parts = conjuncts(s.where) if s.where is not None else []
        summed = self.summed_overlaps(s, *inputs, parts) if len(inputs) == 2 else None
        rel = inputs[0]
        for right in inputs[1:] if summed is None else []:
            rel = self.note(self.join(rel, right, parts))
        if summed is not None:
            rel = self.note(summed)
            return self.finished(s, rel)
        if s.where is not None:
            c, kind = Compiler(rel.kinds)(s.where)
            if kind != BOOLEAN:
                raise PlanError(f"WHERE needs a BOOLEAN, not {kind}")
            rel = self.note(replace(rel, df=rel.df.filter(c), tree=rel.step(f"Filter {show(s.where)}")))
        terms = self.named_terms(s, rel)
        if s.group_by or any(has_aggregate(e) for _, e in terms):
            rel = self.note(self.aggregate(rel, s, terms))
        else:
            rel = self.note(self.project(rel, terms))
        return self.finished(s, rel)

    def finished(self, s: Select, rel: Relation) -> Relation:
        if s.order_by:
            rel = self.note(self.sort(rel, s.order_by))
        if s.limit is not None:
            rel = self.note(replace(rel, df=rel.df.limit(s.limit), tree=rel.step(f"Limit {s.limit}")))
        return rel

    def note(self, rel: Relation) -> Relation:
        if self.observed is None:
            return rel
        from pyspark.sql import Observation

        watch = Observation()
        self.observed.append((rel.tree[0], watch))
        counted = [F.count(F.lit(1)).alias("rows")]
        if rel.series:
            counted.append(F.approx_count_distinct(F.hash(*(F.col(c) for c in rel.series))).alias("series"))
        return replace(rel, df=rel.df.observe(watch, *counted))

    def source(self, table: object, alias: str | None, joined: bool, s: Select) -> Relation:
        if joined and alias is None:
            raise PlanError("all inputs of a join need an alias")
        if joined and len({x.alias for x in s.sources}) < len(s.sources):
            raise PlanError("aliases of joined inputs must differ")
        if isinstance(table, Select):
            rel = self.plan(table)
        else:
            parts = conjuncts(s.where) if s.where is not None else []
            rel = self.lookup(table, [unprefixed(e, alias) for e in parts] if alias else [] if joined else parts)
        if alias is None:
            return self.note(rel)
        # Un-prefixed reserved columns, and every column with its prefix.
        own = [c for c in RESERVED if c in rel.kinds]
        names = {c: f"{alias}.{c}" for c in rel.kinds}
        df = rel.df.select(*(F.col(q(c)) for c in own), *(F.col(q(c)).alias(n) for c, n in names.items()), *(F.col(h) for h in rel.series))
        kinds = {c: rel.kinds[c] for c in own} | {n: rel.kinds[c] for c, n in names.items()}
        return self.note(Relation(df, kinds, {names[k] for k in rel.keys}, rel.series, rel.step(f"Alias {alias}")))

    def join(self, left: Relation, right: Relation, parts: list[object]) -> Relation:
        for side in (left, right):
            if START not in side.kinds or END not in side.kinds:
                raise PlanError("both inputs of a temporal join need _start_time and _end_time")
        on = []
        for e in parts:
            if isinstance(e, Binary) and e.op == "=":
                for a, b in ((e.left, e.right), (e.right, e.left)):
                    if names_in(a) and names_in(b) and names_in(a) <= set(left.kinds) - set(RESERVED) and names_in(b) <= set(right.kinds) - set(RESERVED):
                        (x, kind), (y, other) = Compiler(left.kinds)(a), Compiler(right.kinds)(b)
                        if kind == other:
                            on.append((x, y))
                        break
        hidden = [f"__s{i}" for i in range(len(left.series) + len(right.series))]
        a = left.df.withColumnsRenamed(dict(zip(left.series, hidden)))
        b = right.df.withColumnsRenamed(dict(zip(right.series, hidden[len(left.series) :])))
        df = temporal_join(a, b, on)
        rest = {**{c: k for c, k in left.kinds.items() if c not in RESERVED}, **{c: k for c, k in right.kinds.items() if c not in RESERVED}}
        tree = [f"TemporalJoin ({len(on)} equal columns)", *("  " + x for x in left.tree + right.tree)]
        return Relation(df, {**dict.fromkeys(RESERVED, NUMERIC), **rest}, left.keys | right.keys, hidden, tree)

    def summed_overlaps(self, s: Select, left: Relation, right: Relation, parts: list[object]) -> Relation | None:
        """A temporal join without conditions on both sides of which only counts and sums are wanted: of columns of one
        side each and of the length of the intersection. No pair of rows is made. None for any other statement."""
        own = [set(side.kinds) - set(RESERVED) for side in (left, right)]
        if any(START not in side.kinds or END not in side.kinds for side in (left, right)) or not set(s.group_by) <= own[0] | own[1]:
            return None
        kinds = {**dict.fromkeys(RESERVED, NUMERIC), **{c: k for side in (left, right) for c, k in side.kinds.items() if c not in RESERVED}}
        if any(not names_in(e) or not any(names_in(e) <= side for side in own) for e in parts):
            return None
        terms, sums, typing = self.named_terms(s, Relation(None, kinds)), {}, Compiler(kinds)
        for n, e in terms:
            if isinstance(e, Call) and e.function == "SUM" and len(e.args) == 1:
                found = linear(e.args[0], typing, own)
                if found is None or found[2] != -found[3]:
                    return None
                f, g, _, c, constant = found
                f = F.lit(constant) if f is None and constant else f if not constant else f + F.lit(constant)
                sums[n] = (f, g, c)
            elif not (isinstance(e, Name) and e.path in s.group_by or isinstance(e, Call) and e.function == "COUNT" and len(e.args) == 1):
                return None
        if not any(isinstance(e, Call) for _, e in terms):
            return None
        for _, e in terms:
            Compiler(kinds, F.lit(0), set(s.group_by), F.col)(e)
        frames = []
        for side, names in zip((left, right), own, strict=True):
            df = side.df
            for e in parts:
                if names_in(e) <= names:
                    df = df.filter(typing.typed(e, BOOLEAN, False))
            frames.append(df)
        groups = [[c for c in dict.fromkeys(s.group_by) if c in names] for names in own]
        out = overlap_sums(*frames, *groups, {f"__sum{i}": v for i, v in enumerate(sums.values())})
        made = {n: f"__sum{i}" for i, n in enumerate(sums)}
        columns = [(F.col(made[n]) if n in made else F.col(q(e.path)) if isinstance(e, Name) else F.col("__n").cast("double")).alias(n) for n, e in terms]
        series = F.struct(*(F.col(q(c)) for c in dict.fromkeys(s.group_by))) if s.group_by else F.lit(0)
        tree = ["SummedOverlaps by [" + ", ".join(s.group_by) + "] " + ", ".join(f"{show(e)} AS {n}" for n, e in terms), *("  " + x for x in left.tree + right.tree)]
        given = {n: kinds[e.path] if isinstance(e, Name) else NUMERIC for n, e in terms}
        return Relation(out.select(*columns, series.alias("__s0")), given, {n for n, e in terms if isinstance(e, Name)}, ["__s0"], tree)

    def named_terms(self, s: Select, rel: Relation) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = []
        for t in s.terms:
            if isinstance(t.expr, Star):
                out += [(c, Name(c)) for c in rel.kinds]
            else:
                out.append((t.alias or (t.expr.path if isinstance(t.expr, Name) else f"_{len(out)}"), t.expr))
        require_distinct([n for n, _ in out])
        return out

    def project(self, rel: Relation, terms: list[tuple[str, object]]) -> Relation:
        compiler = Compiler(rel.kinds)
        made = {n: compiler(e) for n, e in terms}
        keys = {n for n, e in terms if names_in(e) <= rel.keys}
        df = rel.df.select(*(c.alias(n) for n, (c, _) in made.items()), *(F.col(h) for h in rel.series))
        out = Relation(df, {n: k for n, (_, k) in made.items()}, keys, rel.series, rel.step("Project " + ", ".join(f"{show(e)} AS {n}" for n, e in terms)))
        return self.merged(out) if self.loses_values(rel, terms) else out

    @staticmethod
    def loses_values(rel: Relation, terms: list[tuple[str, object]]) -> bool:
        """Whether a projection keeps the bounds in front and drops a value column, so that equal rows may touch."""
        if [e for _, e in terms[:2]] != [Name(START), Name(END)] or [n for n, _ in terms[:2]] != [START, END]:
            return False
        plain = lambda c: c.rpartition(".")[2]
        values = {c for c in rel.kinds if c not in rel.keys and plain(c) not in RESERVED}
        return {e.path for _, e in terms if isinstance(e, Name)} & values != values

    @staticmethod
    def merged(rel: Relation) -> Relation:
        columns = list(rel.kinds)
        values = [c for c in columns if c not in RESERVED and c not in rel.keys]
        keys = [c for c in columns if c in rel.keys]
        df = rel.df
        stale = DURATION in columns and columns.index(DURATION) != 2
        if stale:  # the first row's duration stays
            df = df.withColumnRenamed(DURATION, "__duration")
        df = coalesce_intervals(df, [*rel.series, *keys], values)
        if stale:
            df = df.withColumnRenamed("__duration", DURATION)
        return replace(rel, df=df, tree=rel.step("IntervalMerging"))

    def aggregate(self, rel: Relation, s: Select, terms: list[tuple[str, object]]) -> Relation:
        if START not in rel.kinds or END not in rel.kinds:
            raise PlanError("an aggregate needs _start_time and _end_time in its input")
        unknown = [c for c in s.group_by if c not in rel.kinds]
        if unknown:
            raise PlanError(f"unknown columns in GROUP BY: {', '.join(unknown)}")
        temporal = bool({START, END} & set(s.group_by))
        groups = [c for c in dict.fromkeys(s.group_by) if c not in (START, END)]
        df = rel.df
        if temporal:
            bounds = [n for n, _ in terms[:2]] == [START, END] and [e for _, e in terms[:2]] == [Name(START), Name(END)]
            if bounds and terms[2:] and all(self.sweepable(e, groups) for _, e in terms[2:]):
                return self.counted(rel, groups, terms)
            if bounds and terms[2:] and all(self.sweepable(e, groups) or self.extreme(e) for _, e in terms[2:]):
                return self.counted(rel, groups, terms, extremes=True)
            if [n for n, _ in terms[:2]] != [START, END] or [e for _, e in terms[:2]] != [Name(START), Name(END)]:
                raise PlanError("a temporal aggregate selects _start_time, _end_time first")
            # The order of rows is that of the rows themselves, not of the slices they are cut into.
            df = df.withColumns({"__rs": F.col(START), "__re": F.col(END)})
            df = sliced(df, groups).drop(START, END).withColumnsRenamed({"__s": START, "__e": END})
            order = F.struct(*rel.series, "__rs", "__re")
            by = [START, END, *groups]
        else:
            order = F.struct(*rel.series, START, END)
            by = groups

        def bare(name: str):
            if name == START and not temporal:
                return F.min(F.col(START))
            if name == END and not temporal:
                return F.max(F.col(END))
            return F.min_by(F.col(q(name)), order)

        compiler = Compiler(rel.kinds, order, set(by), bare)
        made = {n: compiler(e) for n, e in terms}
        columns = [c.alias(f"__out{i}") for i, (c, _) in enumerate(made.values())]
        present = F.count(F.lit(1)).alias("__rows")
        out = df.groupBy(*(F.col(q(c)) for c in by)).agg(*columns, present)
        if not by:
            out = out.filter("__rows > 0")
        # Each group is a time series of its own, selected or not.
        series = F.struct(*(F.col(q(c)) for c in groups)) if groups else F.lit(0)
        out = out.select(*(F.col(f"__out{i}").alias(n) for i, n in enumerate(made)), series.alias("__s0"))
        kinds = {n: k for n, (_, k) in made.items()}
        keys = {n for n, e in terms if not has_aggregate(e) and names_in(e) <= set(groups) and names_in(e)}
        kind = "TemporalAggregate" if temporal else "Aggregate"
        rel = Relation(out, kinds, keys, ["__s0"], rel.step(f"{kind} by [{', '.join(by)}] " + ", ".join(f"{show(e)} AS {n}" for n, e in terms)))
        return self.merged(rel) if temporal else rel

    @staticmethod
    def sweepable(e: object, groups: list[str]) -> bool:
        """Counts whose condition does not depend on the slice, and group columns."""
        if isinstance(e, Name):
            return e.path in groups
        return isinstance(e, Call) and (e.function == "COUNT" or e.function == "COUNT_IF" and not names_in(e) & {START, END})

    @staticmethod
    def extreme(e: object) -> bool:
        """Minima and maxima of what does not depend on the slice."""
        return isinstance(e, Call) and e.function in ("MIN", "MAX") and not names_in(e) & {START, END}

    def counted(self, rel: Relation, groups: list[str], terms: list[tuple[str, object]], extremes: bool = False) -> Relation:
        """A temporal aggregate of nothing but counts: a sweep over change points instead of a row for every slice. With
        minima and maxima: a tree over the slices."""
        typing, inner = Compiler(rel.kinds, F.lit(0), set(groups), F.col), Compiler(rel.kinds)
        for _, e in terms[2:]:
            typing(e)
        kept = {g: f"__g{i}" for i, g in enumerate(groups)}
        conditions = {n: inner(e.args[0])[0].alias(f"__if{i}") for i, (n, e) in enumerate(terms) if isinstance(e, Call) and e.function == "COUNT_IF"}
        of = {n: (e.function, *inner(e.args[0])) for n, e in terms if isinstance(e, Call) and self.extreme(e)}
        inputs = [c.alias(f"__of{i}") for i, (_, c, _) in enumerate(of.values())]
        df = rel.df.select(START, END, *(F.col(q(g)).alias(n) for g, n in kept.items()), *conditions.values(), *inputs)
        counts = {n: F.col(f"__if{i}") if n in conditions else None for i, (n, e) in enumerate(terms) if isinstance(e, Call) and n not in of}
        swept = self.tree_of_slices(df, list(kept.values()), counts, of) if extremes else temporal_counts(df, list(kept.values()), counts)
        out = [F.col(START), F.col(END)] + [F.col(kept[e.path]).alias(n) if isinstance(e, Name) else F.col(q(n)) for n, e in terms[2:]]
        series = F.struct(*(F.col(n) for n in kept.values())) if kept else F.lit(0)
        kinds = {n: of[n][2] if n in of else NUMERIC if not isinstance(e, Name) else rel.kinds[e.path] for n, e in terms}
        keys = {n for n, e in terms if isinstance(e, Name) and e.path in groups}
        return Relation(swept.select(*out, series.alias("__s0")), kinds, keys, ["__s0"], rel.step(f"TemporalCount by [{', '.join([START, END, *groups])}] " + ", ".join(f"{show(e)} AS {n}" for n, e in terms)))

    @staticmethod
    def tree_of_slices(df: DataFrame, keys: list[str], counts: dict[str, Column | None], of: dict[str, tuple[str, Column, str]]) -> DataFrame:
        parts = {n: ((F.lit(1) if c is None else F.coalesce(c.cast("int"), F.lit(0))).cast("long"), F.sum) for n, c in counts.items()}
        for i, (n, (function, _, kind)) in enumerate(of.items()):
            parts[n] = (F.col(f"__of{i}"), F.min if function == "MIN" else F.max)
            if function == "MIN" and kind == NUMERIC:  # not-a-number wins
                parts[f"__nan{i}"] = (F.isnan(f"__of{i}"), F.max)
        out = {n: F.col(q(n)).cast("double") for n in counts}
        for i, n in enumerate(of):
            out[n] = F.when(F.col(f"__nan{i}"), F.lit(float("nan"))).otherwise(F.col(q(n))) if f"__nan{i}" in parts else F.col(q(n))
        found = tiled(df, keys, parts).select(F.col("__s").alias(START), F.col("__e").alias(END), *map(F.col, keys), *(c.alias(n) for n, c in out.items()))
        return coalesce_intervals(found, keys, list(out))

    def sort(self, rel: Relation, by: tuple[tuple[str, bool], ...]) -> Relation:
        unknown = [c for c, _ in by if c not in rel.kinds]
        if unknown:
            raise PlanError(f"unknown columns in ORDER BY: {', '.join(unknown)}")
        first: dict[str, bool] = {}
        for c, ascending in by:
            first.setdefault(c, ascending)
        columns = [F.col(q(c)).asc() if up else F.col(q(c)).desc() for c, up in first.items()]
        # Ties keep input order: by series, then time.
        ties = [F.col(c) for c in rel.series] + [F.col(c) for c in (START, END) if c in rel.kinds and c not in first]
        return replace(rel, df=rel.df.orderBy(*columns, *ties), tree=rel.step("Sort " + ", ".join(f"{c}{'' if up else ' DESCENDING'}" for c, up in first.items())))
