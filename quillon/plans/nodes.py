"""The syntax tree of T-SQL."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: object
    narrow: bool = False
    places: int | None = None


@dataclass(frozen=True)
class Name(Node):
    parts: tuple


@dataclass(frozen=True)
class Star(Node):
    qualifier: str | None = None


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    e: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str
    a: Node
    b: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str  # AND, OR
    a: Node
    b: Node


@dataclass(frozen=True)
class Not(Node):
    e: Node


@dataclass(frozen=True)
class IsNull(Node):
    e: Node
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    e: Node
    lo: Node
    hi: Node
    negated: bool


@dataclass(frozen=True)
class In(Node):
    e: Node
    items: tuple | None
    query: object
    negated: bool


@dataclass(frozen=True)
class Like(Node):
    e: Node
    pattern: Node
    escape: Node | None
    negated: bool


@dataclass(frozen=True)
class Exists(Node):
    query: object


@dataclass(frozen=True)
class Quantified(Node):
    op: str
    e: Node
    every: bool
    query: object


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    whens: tuple
    default: Node | None


@dataclass(frozen=True)
class Over:
    partition: tuple
    order: tuple  # (expression, descending)
    frame: tuple | None  # (ROWS or RANGE, start, end); a bound is (kind, n)


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple
    distinct: bool = False
    over: Over | None = None
    within: tuple | None = None


@dataclass(frozen=True)
class Cast(Node):
    e: Node
    type: str
    size: tuple
    safe: bool = False
    style: Node | None = None


@dataclass(frozen=True)
class Sub(Node):
    query: object


CONDITIONS = (Compare, Logic, Not, IsNull, Between, In, Like, Exists, Quantified)


@dataclass(frozen=True)
class Item:
    e: Node
    alias: str | None
    var: str | None = None
    op: str = "="


@dataclass(frozen=True)
class Source:
    table: tuple | None = None
    query: object = None
    values: tuple | None = None
    alias: str | None = None
    columns: tuple | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # first, inner, left, right, full, cross, cross apply, outer apply
    source: Source
    on: Node | None = None


@dataclass(frozen=True)
class Select:
    items: tuple
    joins: tuple = ()
    where: Node | None = None
    group: tuple = ()
    having: Node | None = None
    distinct: bool = False
    top: Node | None = None
    percent: bool = False
    ties: bool = False
    into: str | None = None


@dataclass(frozen=True)
class Query:
    """Branches joined by set operators, strictly from left to right; order and paging hold for the whole."""

    branches: tuple
    ops: tuple = ()
    order: tuple = ()
    offset: Node | None = None
    fetch: Node | None = None
    ctes: tuple = ()  # (name, query)


@dataclass
class Statement:
    kind: str
    data: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["data"][name]
        except KeyError:
            raise AttributeError(name) from None
