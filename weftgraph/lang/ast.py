"""Syntax tree: expressions, patterns and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass
class Lit(Expr):
    value: Any


@dataclass
class Var(Expr):
    name: str


@dataclass
class Ref(Expr):
    """``$-``, ``$^``, ``$$`` or ``$name``."""

    name: str


@dataclass
class Prop(Expr):
    base: Expr
    name: str


@dataclass
class Index(Expr):
    base: Expr
    index: Expr


@dataclass
class Slice(Expr):
    base: Expr
    start: Expr | None
    end: Expr | None


@dataclass
class Window:
    partition: list[Expr]
    order: list[tuple[Expr, bool]]
    frame: tuple[int | None, int | None] | None = None


@dataclass
class Call(Expr):
    name: str
    args: list[Expr]
    distinct: bool = False
    star: bool = False
    filter: Expr | None = None
    within: list[tuple[Expr, bool]] | None = None
    over: Window | None = None


@dataclass
class Unary(Expr):
    op: str
    arg: Expr


@dataclass
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    otherwise: Expr | None


@dataclass
class Cast(Expr):
    arg: Expr
    type: str
    lenient: bool = False


@dataclass
class ListLit(Expr):
    items: list[Expr]


@dataclass
class MapLit(Expr):
    items: list[tuple[str, Expr]]


@dataclass
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass
class Reduce(Expr):
    acc: str
    init: Expr
    var: str
    source: Expr
    step: Expr


@dataclass
class Exists(Expr):
    pattern: list[PathPattern]
    where: Expr | None


@dataclass
class InQuery(Expr):
    arg: Expr
    query: Query
    negated: bool = False


@dataclass
class NodePattern:
    var: str | None = None
    labels: list[str] = field(default_factory=list)
    props: list[tuple[str, Expr]] = field(default_factory=list)


@dataclass
class EdgePattern:
    var: str | None = None
    types: list[str] = field(default_factory=list)
    props: list[tuple[str, Expr]] = field(default_factory=list)
    direction: str = "out"
    hops: tuple[int, int | None] | None = None


@dataclass
class PathPattern:
    elements: list[NodePattern | EdgePattern]
    var: str | None = None
    optional: bool = False


@dataclass
class Item:
    expr: Expr
    alias: str | None
    text: str


@dataclass
class Match:
    patterns: list[PathPattern]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Projection:
    """RETURN, WITH or YIELD."""

    items: list[Item] | None
    distinct: bool = False
    where: Expr | None = None
    group: list[Expr] | None = None
    grouping: tuple[str, list[list[Expr]]] | None = None
    having: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    scope: bool = False


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class Go:
    low: int
    high: int
    sources: list[Expr]
    types: list[str]
    direction: str
    where: Expr | None = None
    result: Projection | None = None


@dataclass
class Fetch:
    names: list[str]
    ids: list[Expr] = field(default_factory=list)
    edges: list[tuple[Expr, Expr, Expr | None]] = field(default_factory=list)
    result: Projection | None = None


@dataclass
class Lookup:
    name: str
    where: Expr | None = None
    result: Projection | None = None


@dataclass
class FindPath:
    shortest: bool
    sources: list[Expr]
    targets: list[Expr]
    types: list[str]
    direction: str = "out"
    cycle: bool = False
    loop: bool = False
    where: Expr | None = None
    upto: int | None = None
    weight: str | None = None
    result: Projection | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass
class Subgraph:
    steps: int
    sources: list[Expr]
    types: list[str]
    direction: str = "both"
    with_edge: bool = True
    where: Expr | None = None
    result: Projection | None = None


@dataclass
class Search:
    index: str
    query: str
    result: Projection | None = None
    where: Expr | None = None
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None


@dataclass
class VectorSearch:
    index: str
    query: Expr
    limit: int = 10
    threshold: float | None = None
    where: Expr | None = None
    result: Projection | None = None


@dataclass
class Tail:
    """ORDER BY, LIMIT, SKIP, OFFSET, SAMPLE or WHERE as a pipe's right-hand side."""

    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    sample: int | None = None
    where: Expr | None = None


@dataclass
class GroupBy:
    keys: list[Expr]
    result: Projection


@dataclass
class Cypher:
    clauses: list[Any]


@dataclass
class InsertVertices:
    tags: list[tuple[str, list[str]]]
    rows: list[tuple[Expr, list[list[Expr]]]]
    if_not_exists: bool = False


@dataclass
class InsertEdges:
    type: str
    props: list[str]
    rows: list[tuple[Expr, Expr, Expr | None, list[Expr]]]
    if_not_exists: bool = False


@dataclass
class CreatePattern:
    patterns: list[PathPattern]


@dataclass
class Update:
    kind: str
    key: tuple[Expr, ...]
    name: str | None
    sets: list[tuple[str, Expr]]
    where: Expr | None = None
    result: Projection | None = None
    insert: bool = False


@dataclass
class Delete:
    kind: str
    names: list[str] = field(default_factory=list)
    ids: list[Expr] = field(default_factory=list)
    edges: list[tuple[Expr, Expr, Expr | None]] = field(default_factory=list)
    with_edge: bool = False


@dataclass
class DeleteMatched:
    vars: list[str]
    detach: bool = False


@dataclass
class SetMatched:
    sets: list[tuple[str, str, Expr]]


@dataclass
class RemoveMatched:
    props: list[tuple[str, str]]
    labels: list[tuple[str, str]]


@dataclass
class Merge:
    pattern: PathPattern
    on_match: list[tuple[str, str, Expr]]
    on_create: list[tuple[str, str, Expr]]


@dataclass
class Admin:
    """Schema and session statements: a verb, what it acts on and its arguments."""

    verb: str
    what: str
    name: str | None = None
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Assign:
    name: str
    query: Query


@dataclass
class Query:
    """Pipes joined by set operators: parts[0], then (operator, pipe) pairs."""

    first: list[Any]
    rest: list[tuple[str, list[Any]]] = field(default_factory=list)


@dataclass
class Explain:
    query: Any
    profile: bool = False
    format: str = "TABLE"
