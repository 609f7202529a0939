"""Finding phases, resources and metrics in a tree by path expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PlanError


class PathError(PlanError):
    """An expression that is malformed or matches nothing."""


def split_path(path: str) -> list[str]:
    """Components between slashes that are not inside brackets."""
    return [c for c in re.findall(r"(?:[^/\[]|\[[^\]]*\])+", path)]


def component_regex(component: str) -> str:
    """A component matches a name or a whole identifier; ``*`` any text within it; a last ``*`` brackets, too."""
    if component.count("[") != component.count("]") or "**" in component:
        raise PathError(f"invalid component {component!r}")
    name, bracket, tags = component.partition("[")
    star = lambda text: "".join(r"[^/\[\]]*" if c == "*" else re.escape(c) for c in text)
    if bracket:
        inner = tags.rstrip("]")
        return star(name) + r"\[" + "".join(r"[^\]]*" if c == "*" else re.escape(c) for c in inner) + r"\]"
    return star(name) + r"(?:\[[^\]]*\])?"


def steps_of(expression: str) -> list[str]:
    """The components of an expression, all valid, without those that mean the same node."""
    steps = [c for c in split_path(expression) if c != "."]
    for c in steps:
        if c not in ("**", ".."):
            component_regex(c)
    return steps


def match_tree(paths: list[str], expression: str, base: str = "/") -> list[str]:
    """The paths of a tree that an expression selects, walking from the root or, if it is relative, from ``base``.

    ``**`` stands for descendants at any depth, not for the node itself. ``..`` goes from the nodes found so far to
    their parents, so ``/a/*/..`` finds ``/a`` only if that has a child.
    """
    known = {tuple(split_path(p)): p for p in paths}
    below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for node in known:
        if node:
            below.setdefault(node[:-1], []).append(node)

    def descendants(node: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for child in below.get(node, ()):
            yield child
            yield from descendants(child)

    found = {() if expression.startswith("/") else tuple(split_path(base))}
    for step in steps_of(expression):
        if step == "..":
            found = {node[:-1] for node in found if node}
        elif step == "**":
            found = {child for node in found for child in descendants(node)}
        else:
            pattern = re.compile(component_regex(step))
            found = {child for node in found for child in below.get(node, ()) if pattern.fullmatch(child[-1])}
    out = [p for node, p in known.items() if node in found]
    if not out:
        raise PathError(f"nothing matches {expression!r}")
    return out


def matches_tree(path: Column, expression: str) -> Column:
    """Whether an absolute expression selects a path, told from the path alone; ``..`` would need the tree."""
    steps = steps_of(expression)
    if ".." in steps or not expression.startswith("/"):
        raise PathError(f"{expression!r} can only be followed in a tree")
    if not steps:
        return path == "/"
    return path.rlike(r"\A" + "".join(r"(?:/(?:[^/\[]|\[[^\]]*\])+)+" if c == "**" else "/" + component_regex(c) for c in steps) + r"\z")


def matches_metric(path: Column, expression: str) -> Column:
    """``resource expression:metric pattern``, where ``*`` in the metric's name is any text."""
    resource, colon, metric = expression.rpartition(":")
    if not colon:
        raise PathError(f"{expression!r} names no metric")
    name = "".join(".*" if c == "*" else re.escape(c) for c in metric)
    return matches_tree(F.substring_index(path, ":", 1), resource) & F.substring_index(path, ":", -1).rlike(rf"\A{name}\z")
