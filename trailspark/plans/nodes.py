"""Syntax tree: expressions, operators, pipelines. Every node knows its token."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import Token


@dataclass
class Node:
    token: Token


@dataclass
class Literal(Node):
    value: object
    type: str


@dataclass
class Name(Node):
    name: str


@dataclass
class Member(Node):
    base: Node
    key: str | int | Node


@dataclass
class Call(Node):
    name: str
    args: list[Node]


@dataclass
class Unary(Node):
    op: str
    arg: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class InList(Node):
    op: str  # in, in~, has_any, has_all
    negated: bool
    left: Node
    items: list[Node]


@dataclass
class Between(Node):
    negated: bool
    left: Node
    low: Node
    high: Node


@dataclass
class Item(Node):
    """A named or unnamed expression of a list."""

    name: str | None
    expr: Node


@dataclass
class Operator(Node):
    name: str
    exprs: list = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    by: list[Item] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    pipelines: list = field(default_factory=list)


@dataclass
class Pipeline(Node):
    source: object  # a name, or a pipeline in brackets
    operators: list[Operator]


@dataclass
class Let(Node):
    name: str
    value: Node


@dataclass
class Script:
    lets: list[Let]
    main: Pipeline
