"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field

from gridloom.types import Matcher


class Node:
    """Base of all nodes."""


@dataclass(frozen=True)
class Number(Node):
    value: float


@dataclass(frozen=True)
class String(Node):
    value: str


@dataclass(frozen=True)
class Selector(Node):
    """A vector selector, or a matrix selector if range_ns is set."""

    name: str | None
    matchers: tuple[Matcher, ...] = ()
    range_ns: int | None = None
    offset_ns: int = 0


@dataclass(frozen=True)
class Subquery(Node):
    expr: Node
    range_ns: int
    step_ns: int | None
    offset_ns: int = 0


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    expr: Node
    param: Node | None = None
    by: bool | None = None  # True: by, False: without, None: no modifier
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Matching:
    on: bool | None = None  # True: on, False: ignoring, None: default
    labels: tuple[str, ...] = ()
    group: str | None = None  # left or right
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    bool_modifier: bool = False
    matching: Matching = field(default_factory=Matching)


@dataclass(frozen=True)
class Negation(Node):
    expr: Node


@dataclass(frozen=True)
class Paren(Node):
    expr: Node
