"""Tokens, syntax trees and the parser of the FROM-first query language.

Precedence, tightest first: calls and parentheses, unary minus, ``* /``, ``+ -``, comparisons, NOT, AND, OR. Keywords
are case-insensitive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..schema import PlanError


class ParseError(PlanError):
    """Text that is not a statement of the language."""


@dataclass(frozen=True)
class Literal:
    value: float | str | bool


@dataclass(frozen=True)
class Name:
    path: str  # with an optional qualifier, "a.b"


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Term:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: object  # a name or a Select
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    sources: tuple[Source, ...]
    terms: tuple[Term, ...]
    where: object | None = None
    group_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()  # (column, ascending)
    limit: int | None = None


@dataclass(frozen=True)
class Statement:
    kind: str  # select, create, delete, cache, uncache, explain, statistics, export
    select: Select | None = None
    name: str | None = None


KEYWORDS = {
    *"FROM AS TEMPORAL JOIN WHERE GROUP BY SELECT ORDER DESCENDING LIMIT CREATE DELETE CACHE DROP TABLE EXPLAIN STATISTICS EXPORT TRUE FALSE AND OR NOT".split()
}
TOKEN = re.compile(
    r"""\s+|//[^\n]*
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>"[^"]*")
    |(?P<word>[A-Za-z_]\w*)
    |(?P<symbol>~=|!~|!=|==|>=|<=|&&|\|\||[=<>+\-*/!(),.;])""",
    re.VERBOSE,
)
COMPARISONS = {"=": "=", "==": "=", "!=": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "~=": "~=", "!~": "!~"}


@dataclass
class Parser:
    text: str
    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place = 0
        while place < len(self.text):
            m = TOKEN.match(self.text, place)
            if m is None:
                raise ParseError(f"unexpected character {self.text[place]!r} at {place}")
            if m.lastgroup:
                kind, value = m.lastgroup, m.group()
                if kind == "word" and value.upper() in KEYWORDS:
                    kind, value = "keyword", value.upper()
                self.tokens.append((kind, value, place))
            place = m.end()
        self.tokens.append(("end", "", place))

    def peek(self, *values: str) -> bool:
        kind, value, _ = self.tokens[self.at]
        return kind in ("keyword", "symbol") and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        got = self.take(*values)
        if got is None:
            self.fail(" or ".join(values))
        return got

    def fail(self, wanted: str) -> None:
        _, value, place = self.tokens[self.at]
        raise ParseError(f"expected {wanted} at {place}, found {value or 'the end'}")

    def of_kind(self, kind: str, wanted: str) -> str:
        if self.tokens[self.at][0] != kind:
            self.fail(wanted)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def identifier(self) -> str:
        return self.of_kind("word", "a name")

    def column(self) -> str:
        name = self.identifier()
        return f"{name}.{self.identifier()}" if self.take(".") else name

    def statements(self) -> list[Statement]:
        out = []
        while self.tokens[self.at][0] != "end":
            out.append(self.statement())
            self.need(";")
        if not out:
            self.fail("a statement")
        return out

    def statement(self) -> Statement:
        if self.peek("FROM"):
            return Statement("select", self.select())
        word = self.need("CREATE", "DELETE", "CACHE", "DROP", "EXPLAIN", "STATISTICS", "EXPORT", "FROM")
        if word in ("EXPLAIN", "STATISTICS"):
            return Statement(word.lower(), self.select())
        if word == "EXPORT":
            path = self.of_kind("string", "a file name")[1:-1]
            self.need("=", "==")
            return Statement("export", self.select(), path)
        self.need("TABLE")
        name = self.identifier()
        if word == "CREATE":
            self.need("=", "==")
            return Statement("create", self.select(), name)
        if word == "DROP":
            self.need("FROM")
            self.need("CACHE")
            return Statement("uncache", name=name)
        return Statement(word.lower(), name=name)

    def select(self) -> Select:
        self.need("FROM")
        sources = [self.source()]
        while self.take("TEMPORAL"):
            self.need("JOIN")
            sources.append(self.source())
        where = self.expression() if self.take("WHERE") else None
        group: list[str] = []
        if self.take("GROUP"):
            self.need("BY")
            group.append(self.column())
            while self.take(","):
                group.append(self.column())
        self.need("SELECT")
        terms = [self.term()]
        while self.take(","):
            terms.append(self.term())
        order: list[tuple[str, bool]] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                name = self.column()
                order.append((name, self.take("DESCENDING") is None))
                if not self.take(","):
                    break
        limit = None
        if self.take("LIMIT"):
            number = self.of_kind("number", "a number of rows")
            if not number.isdigit():
                raise ParseError(f"LIMIT takes a whole number, not {number}")
            limit = int(number)
        return Select(tuple(sources), tuple(terms), where, tuple(group), tuple(order), limit)

    def source(self) -> Source:
        if self.take("("):
            table: object = self.select()
            self.need(")")
        else:
            table = self.identifier()
        return Source(table, self.identifier() if self.take("AS") else None)

    def term(self) -> Term:
        if self.take("*"):
            return Term(Star())
        expr = self.expression()
        return Term(expr, self.identifier() if self.take("AS") else None)

    def expression(self) -> object:
        left = self.conjunction()
        while self.take("OR", "||"):
            left = Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> object:
        left = self.negation()
        while self.take("AND", "&&"):
            left = Binary("AND", left, self.negation())
        return left

    def negation(self) -> object:
        return Unary("NOT", self.negation()) if self.take("NOT", "!") else self.comparison()

    def comparison(self) -> object:
        left = self.sum()
        while op := self.take(*COMPARISONS):
            left = Binary(COMPARISONS[op], left, self.sum())
        return left

    def sum(self) -> object:
        left = self.product()
        while op := self.take("+", "-"):
            left = Binary(op, left, self.product())
        return left

    def product(self) -> object:
        left = self.signed()
        while op := self.take("*", "/"):
            left = Binary(op, left, self.signed())
        return left

    def signed(self) -> object:
        if self.take("+"):
            return self.signed()
        if not self.take("-"):
            return self.primary()
        arg = self.signed()
        return Literal(-arg.value) if isinstance(arg, Literal) and isinstance(arg.value, float) else Unary("-", arg)

    def primary(self) -> object:
        kind, value, _ = self.tokens[self.at]
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if self.take("TRUE", "FALSE"):
            return Literal(value == "TRUE")
        if kind == "number":
            self.at += 1
            return Literal(float(value))
        if kind == "string":
            self.at += 1
            return Literal(value[1:-1])
        if kind == "word":
            name = self.column()
            if "." not in name and self.take("("):
                args = [] if self.peek(")") else [self.expression()]
                while args and self.take(","):
                    args.append(self.expression())
                self.need(")")
                return Call(name.upper(), tuple(args))
            return Name(name)
        self.fail("an expression")
        raise AssertionError


def parse(text: str) -> list[Statement]:
    return Parser(text).statements()


def show(e: object) -> str:
    """An expression as text, fully parenthesized."""
    if isinstance(e, Literal):
        return f'"{e.value}"' if isinstance(e.value, str) else str(e.value).upper() if isinstance(e.value, bool) else f"{e.value:g}"
    if isinstance(e, Name):
        return e.path
    if isinstance(e, Call):
        return f"{e.function}({', '.join(map(show, e.args))})"
    if isinstance(e, Unary):
        return f"{e.op} ({show(e.arg)})"
    if isinstance(e, Binary):
        return f"({show(e.left)} {e.op} {show(e.right)})"
    return "*"
