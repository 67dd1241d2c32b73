"""Parsed query options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str  # string, int, decimal, bool, null, guid, date, datetime


@dataclass(frozen=True)
class Path:
    """Property, or navigations and a property; `it` if it began with $it."""

    parts: tuple[str, ...]
    it: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str  # not, neg
    operand: Any


@dataclass(frozen=True)
class In:
    operand: Any
    items: tuple[Any, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]


@dataclass(frozen=True)
class Lambda:
    path: Path
    op: str  # any, all
    var: str | None
    predicate: Any


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool = False


@dataclass(frozen=True)
class Term:
    text: str
    negated: bool = False


@dataclass(frozen=True)
class Search:
    op: str  # AND, OR
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Expand:
    nav: str
    query: ODataQuery
    count_only: bool = False
    levels: int | str | None = None


@dataclass(frozen=True)
class Aggregate:
    prop: str | None
    method: str
    alias: str


@dataclass(frozen=True)
class FilterStep:
    expr: Any


@dataclass(frozen=True)
class GroupStep:
    """by is None for a global aggregate."""

    by: tuple[str, ...] | None
    aggregates: tuple[Aggregate, ...] = ()


@dataclass(frozen=True)
class ODataQuery:
    filter: Any = None
    select: tuple[str, ...] | None = None
    orderby: tuple[Order, ...] = ()
    top: int | None = None
    skip: int | None = None
    count: bool = False
    search: Any = None
    expand: tuple[Expand, ...] = ()
    apply: tuple[Any, ...] = ()
    custom: dict = field(default_factory=dict)
