r"""Functions of hierarchical paths, as native columns.

A path is components between separators ``/`` or ``:``; a leading separator makes it absolute. Patterns match whole
paths: ``**`` any text, ``*`` any text without ``/``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "/:"


def pattern_regex(pattern: str) -> str:
    """A literal pattern as a regular expression for ``rlike``."""
    parts = re.split(r"(\*\*|\*)", pattern)
    quoted = lambda p: "\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" if p else ""
    return r"(?s)\A(?:" + "".join({"**": ".*", "*": "[^/]*"}.get(p, quoted(p)) for p in parts) + r")\z"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(pattern_regex(pattern))


def matches_either(a: Column, b: Column) -> Column:
    """Match where either side may be the pattern; wildcards on both sides are an error, on neither mean equality."""
    wild_a, wild_b = F.contains(a, F.lit("*")), F.contains(b, F.lit("*"))
    path, pattern = F.when(wild_a, b).otherwise(a), F.when(wild_a, a).otherwise(b)
    quoted = F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    regex = F.replace(quoted, F.lit("**"), F.lit("\\E\x00\\Q"))
    regex = F.replace(F.replace(regex, F.lit("*"), F.lit(r"\E[^/]*\Q")), F.lit("\x00"), F.lit(".*"))
    regex = F.concat(F.lit(r"(?s)\A(?:"), regex, F.lit(r")\z"))
    return F.when(wild_a & wild_b, F.raise_error(F.lit("both sides of a match have wildcards")).cast("boolean")).when(wild_a | wild_b, F.rlike(path, regex)).otherwise(a == b)


def _rest(path: Column, ancestor: Column) -> Column:
    """What follows ``ancestor`` and its separator in ``path``; empty if no boundary is there."""
    n = F.length(ancestor)
    return (
        F.when(ancestor.rlike(r"[/:]\z"), path.substr(n + 1, F.length(path)))
        .when(path.substr(n + 1, F.lit(1)).isin("/", ":"), path.substr(n + 2, F.length(path)))
        .otherwise("")
    )


def is_descendant_of(path: Column, ancestor: Column) -> Column:
    return (ancestor != "") & F.startswith(path, ancestor) & (_rest(path, ancestor) != "")


def is_child_of(path: Column, parent: Column) -> Column:
    return is_descendant_of(path, parent) & ~_rest(path, parent).rlike("[/:]")


def is_ancestor_of(path: Column, descendant: Column) -> Column:
    return is_descendant_of(descendant, path)


def is_parent_of(path: Column, child: Column) -> Column:
    return is_child_of(child, path)


def parent_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.+)[/:][^/:]*\z", 1)


def _prefix(path: Column, n: int) -> Column:
    if n > 0:
        return F.regexp_extract(path, rf"(?s)\A(.[^/:]*(?:[/:][^/:]*){{0,{n - 1}}})", 1)
    leading = F.regexp_extract(path, r"\A([/:]?)", 1)
    if n == 0:
        return leading
    cut = rf"(?s)\A(.+)[/:](?:[^/:]*[/:]){{{-n - 1}}}[^/:]*.\z"
    return F.when(path.rlike(cut), F.regexp_extract(path, cut, 1)).otherwise(leading)


def _suffix(path: Column, n: int) -> Column:
    if n > 0:
        cut = rf"(?s)\A.*[/:]((?:[^/:]*[/:]){{{n - 1}}}[^/:]*.)\z"
        return F.when(path.rlike(cut), F.regexp_extract(path, cut, 1)).otherwise(path)
    if n == 0:
        return F.lit("")
    return F.regexp_extract(path, rf"(?s)\A.(?:[^/:]*[/:]){{{-n}}}(.*)\z", 1)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_parts(path: Column) -> Column:
    """The first character with what follows it up to a separator, then each separator with what follows it."""
    return F.regexp_extract_all(path, F.lit(r"(?s)\A.[^/:]*|[/:][^/:]*"), F.lit(0))


def _closed(parts: Column) -> Column:
    """Parts of which a last one that is a bare separator belongs to the one before."""
    n = F.size(parts)
    joined = F.concat(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(parts, n - 2), F.get(parts, n - 1))))
    return F.when((n > 1) & F.get(parts, n - 1).isin("/", ":"), joined).otherwise(parts)


def _joined(parts: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, F.greatest(first, F.lit(1)), F.greatest(count, F.lit(0))), "")


def _prefix_varying(path: Column, n: Column) -> Column:
    leading = F.regexp_extract(path, r"\A([/:]?)", 1)
    front = _bound(_first_parts(path), lambda p: _joined(p, F.lit(1), n))
    back = _bound(_closed(_first_parts(path)), lambda p: F.when(F.size(p) + n >= 1, _joined(p, F.lit(1), F.size(p) + n)).otherwise(leading))
    return F.when(n > 0, front).when(n == 0, leading).when(n < 0, back)


def _suffix_varying(path: Column, n: Column) -> Column:
    parts = _closed(F.regexp_extract_all(path, F.lit(r"(?s)\A[^/:]+|[/:][^/:]*"), F.lit(0)))
    after = lambda text: F.substring(text, 2, 1 << 30)
    starts = lambda p: F.size(p) - F.when(path.rlike(r"\A[/:].|\A\z"), F.lit(0)).otherwise(F.lit(1))
    back = _bound(parts, lambda p: F.when(starts(p) >= n, after(_joined(p, F.size(p) - n + 1, n))).otherwise(path))
    front = _bound(_first_parts(path), lambda p: F.when(F.size(p) - 1 + n >= 0, after(_joined(p, 1 - n, F.size(p)))).otherwise(""))
    return F.when(n > 0, back).when(n == 0, "").when(n < 0, front)


def _whole(n: Column) -> Column:
    """n rounded half up, held within what any text's length allows."""
    return F.when(n.isNotNull(), F.greatest(F.least(F.floor(n + 0.5), F.lit(1 << 30)), F.lit(-(1 << 30)))).cast("int")


def rounded(n: float) -> int:
    """Half up."""
    import math

    return math.floor(n + 0.5)


def path_prefix(path: Column, n: float | Column) -> Column:
    """n > 0: the first n components; 0: the leading separator; n < 0: all but the last -n."""
    return _prefix(path, rounded(n)) if isinstance(n, (int, float)) else _prefix_varying(path, _whole(n))


def path_suffix(path: Column, n: float | Column) -> Column:
    """n > 0: the last n components; 0: empty; n < 0: all but the first -n."""
    return _suffix(path, rounded(n)) if isinstance(n, (int, float)) else _suffix_varying(path, _whole(n))


def path_depth(path: Column) -> Column:
    absolute = F.when(path.rlike(r"\A[/:]"), F.lit(1)).otherwise(F.lit(0))
    return (F.length(F.regexp_replace(path, "[^/:]", "")) - absolute).cast("double")
