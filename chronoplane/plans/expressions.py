"""From syntax trees to typed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import paths, scalars
from ..schema import BOOLEAN, END, NUMERIC, START, STRING, PlanError, q
from .language import Binary, Call, Literal, Name, Unary, show

Typed = tuple[Column, str]

AGGREGATES = {"COUNT", "COUNT_IF", "MIN", "MAX", "SUM", "AVG", "WEIGHTED_AVG", "AVG_OVER_TIME", "FIND_OR_DEFAULT"}
PATH_TESTS = {"IS_CHILD_OF": paths.is_child_of, "IS_PARENT_OF": paths.is_parent_of, "IS_DESCENDANT_OF": paths.is_descendant_of, "IS_ANCESTOR_OF": paths.is_ancestor_of}
PATH_PARTS = {"PATH_PREFIX": paths.path_prefix, "PATH_SUFFIX": paths.path_suffix}
SCALARS = {"MIN_OF", "MAX_OF", "AS_NUMERIC", "PARENT_OF", "PATH_DEPTH", *PATH_TESTS, *PATH_PARTS}


def has_aggregate(e: object) -> bool:
    if isinstance(e, Call):
        return e.function in AGGREGATES or any(map(has_aggregate, e.args))
    if isinstance(e, Unary):
        return has_aggregate(e.arg)
    return isinstance(e, Binary) and (has_aggregate(e.left) or has_aggregate(e.right))


def names_in(e: object) -> set[str]:
    if isinstance(e, Name):
        return {e.path}
    if isinstance(e, Call):
        return set().union(*map(names_in, e.args)) if e.args else set()
    if isinstance(e, Unary):
        return names_in(e.arg)
    return names_in(e.left) | names_in(e.right) if isinstance(e, Binary) else set()


def conjuncts(e: object) -> list[object]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Binary) and e.op == "AND" else [e]


@dataclass
class Compiler:
    """kinds: the columns in scope. order, groups and outer: set while aggregates are compiled."""

    kinds: dict[str, str]
    order: Column | None = None
    groups: set[str] | None = None
    bare: Callable[[str], Column] | None = field(default=None)  # a column outside aggregates, not grouped by

    def __call__(self, e: object, inside: bool = False) -> Typed:
        if isinstance(e, Literal):
            kind = BOOLEAN if isinstance(e.value, bool) else STRING if isinstance(e.value, str) else NUMERIC
            return F.lit(e.value), kind
        if isinstance(e, Name):
            if e.path not in self.kinds:
                raise PlanError(f"unknown column {e.path}; there are {', '.join(self.kinds)}")
            if self.groups is not None and not inside and e.path not in self.groups:
                return self.bare(e.path), self.kinds[e.path]
            return F.col(q(e.path)), self.kinds[e.path]
        if isinstance(e, Unary):
            wanted = BOOLEAN if e.op == "NOT" else NUMERIC
            c = self.typed(e.arg, wanted, inside)
            return (~c if e.op == "NOT" else -c), wanted
        if isinstance(e, Binary):
            return self.binary(e, inside)
        if isinstance(e, Call):
            return self.call(e, inside)
        raise PlanError(f"{show(e)} cannot stand here")

    def typed(self, e: object, kind: str, inside: bool) -> Column:
        c, got = self(e, inside)
        if got != kind:
            raise PlanError(f"{show(e)} is {got}; {kind} is needed")
        return c

    def binary(self, e: Binary, inside: bool) -> Typed:
        if e.op in ("AND", "OR"):
            a, b = self.typed(e.left, BOOLEAN, inside), self.typed(e.right, BOOLEAN, inside)
            return (a & b if e.op == "AND" else a | b), BOOLEAN
        if e.op in ("+", "-", "*", "/"):
            a, b = self.typed(e.left, NUMERIC, inside), self.typed(e.right, NUMERIC, inside)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: scalars.ieee_div(a, b)}[e.op](), NUMERIC
        if e.op in ("<", "<=", ">", ">="):
            a, b = self.typed(e.left, NUMERIC, inside), self.typed(e.right, NUMERIC, inside)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op], BOOLEAN
        if e.op in ("~=", "!~"):
            a, b = self.typed(e.left, STRING, inside), self.typed(e.right, STRING, inside)
            hit = paths.matches(a, e.right.value) if isinstance(e.right, Literal) else paths.matches_either(a, b)
            return (hit if e.op == "~=" else ~hit), BOOLEAN
        (a, kind), (b, other) = self(e.left, inside), self(e.right, inside)
        if kind != other:
            raise PlanError(f"{show(e)} compares {kind} with {other}")
        same = scalars.equal(a, b, kind)
        return (same if e.op == "=" else ~same), BOOLEAN

    def arity(self, e: Call, least: int, most: int | None = None) -> None:
        if len(e.args) < least or (most is not None and len(e.args) > most):
            raise PlanError(f"{e.function} takes {least if most == least else f'at least {least}'} arguments, not {len(e.args)}")

    def call(self, e: Call, inside: bool) -> Typed:
        if e.function in AGGREGATES:
            if self.order is None or inside:
                raise PlanError(f"{e.function} cannot stand {'inside another aggregate' if inside else 'here'}")
            return self.aggregate(e)
        if e.function in ("MIN_OF", "MAX_OF"):
            self.arity(e, 2)
            args = [self(a, inside) for a in e.args]
            if len({k for _, k in args}) > 1:
                raise PlanError(f"{e.function} takes arguments of one type")
            of = scalars.min_of if e.function == "MIN_OF" else scalars.max_of
            return of(*(c for c, _ in args), kind=args[0][1]), args[0][1]
        if e.function == "AS_NUMERIC":
            self.arity(e, 1, 1)
            return scalars.as_numeric(self.typed(e.args[0], BOOLEAN, inside)), NUMERIC
        if e.function in PATH_TESTS:
            self.arity(e, 2, 2)
            return PATH_TESTS[e.function](*(self.typed(a, STRING, inside) for a in e.args)), BOOLEAN
        if e.function in PATH_PARTS:
            self.arity(e, 2, 2)
            n = e.args[1].value if isinstance(e.args[1], Literal) and isinstance(e.args[1].value, float) else self.typed(e.args[1], NUMERIC, inside)
            return PATH_PARTS[e.function](self.typed(e.args[0], STRING, inside), n), STRING
        if e.function in ("PARENT_OF", "PATH_DEPTH"):
            self.arity(e, 1, 1)
            c = self.typed(e.args[0], STRING, inside)
            return (paths.parent_of(c), STRING) if e.function == "PARENT_OF" else (paths.path_depth(c), NUMERIC)
        raise PlanError(f"unknown function {e.function}")

    def aggregate(self, e: Call) -> Typed:
        f, args = e.function, e.args
        self.arity(e, n := {"WEIGHTED_AVG": 2, "FIND_OR_DEFAULT": 3}.get(f, 1), n)
        if f == "COUNT":
            self(args[0], True)
            return agg.count(), NUMERIC
        if f == "COUNT_IF":
            return agg.count_if(self.typed(args[0], BOOLEAN, True)), NUMERIC
        if f in ("MIN", "MAX"):
            c, kind = self(args[0], True)
            return (agg.minimum if f == "MIN" else agg.maximum)(c, kind), kind
        if f == "FIND_OR_DEFAULT":
            flag, (v, kind), (d, other) = self.typed(args[0], BOOLEAN, True), self(args[1], True), self(args[2], True)
            if kind != other:
                raise PlanError(f"FIND_OR_DEFAULT takes a value and a default of one type, not {kind} and {other}")
            return agg.find_or_default(flag, v, d, self.order), kind
        numbers = [self.typed(a, NUMERIC, True) for a in args]
        if f == "AVG_OVER_TIME":
            return agg.average_over_time(numbers[0], F.col(START), F.col(END)), NUMERIC
        return {"SUM": agg.total, "AVG": agg.average, "WEIGHTED_AVG": agg.weighted_average}[f](*numbers), NUMERIC
