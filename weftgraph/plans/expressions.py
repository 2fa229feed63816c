"""Expressions of the syntax tree into Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from weftgraph.functions import geo, vector  # noqa: F401  (they register their functions)
from weftgraph.functions.aggregate import AGGREGATES, DISTINCT, group_concat, is_aggregate
from weftgraph.functions.scalar import CUSTOM, REGISTRY, lit
from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.model import spark_type

FULL = (Window.unboundedPreceding, Window.unboundedFollowing)
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Element:
    """A node or edge of a pattern: where its keys and properties are among a DataFrame's columns."""

    kind: str
    keys: dict[str, str]
    props: dict[str, str]
    names: list[str]
    #: Column that holds the tag or type of each row, where patterns leave several open.
    name_column: str | None = None


@dataclass
class PathValue:
    """A path of a pattern: its elements' variables in order, or one struct column with ``nodes`` and ``edges``."""

    parts: list[str] = field(default_factory=list)
    column: str | None = None


@dataclass
class Scope:
    """A DataFrame and what its columns mean to the statement being translated."""

    df: DataFrame
    values: dict[str, str] = field(default_factory=dict)
    elements: dict[str, Element] = field(default_factory=dict)
    paths: dict[str, PathValue] = field(default_factory=dict)
    piped: bool = False

    def known(self, name: str) -> bool:
        return name in self.values or name in self.elements or name in self.paths


def plain(df: DataFrame, piped: bool = False) -> Scope:
    return Scope(df, {c: c for c in df.columns}, piped=piped)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def walk(e: Any) -> Iterator[A.Expr]:
    """An expression and everything below it, patterns and subqueries left out."""
    if isinstance(e, A.Expr):
        yield e
        if isinstance(e, (A.Exists, A.InQuery)):
            if isinstance(e, A.InQuery):
                yield from walk(e.arg)
            return
    if is_dataclass(e):
        for f in fields(e):
            yield from walk(getattr(e, f.name))
    elif isinstance(e, (list, tuple)):
        for x in e:
            yield from walk(x)


def aggregates(e: Any) -> list[A.Call]:
    return [x for x in walk(e) if isinstance(x, A.Call) and x.over is None and is_aggregate_call(x)]


def is_aggregate_call(x: A.Call) -> bool:
    """``bit_and`` and its like are aggregates of one argument and scalars of two; ``corr`` and ``collect`` have one form."""
    if x.name in REGISTRY and x.name in AGGREGATES:
        return len(x.args) == 1
    return is_aggregate(x.name)


def windows(e: Any) -> list[A.Call]:
    return [x for x in walk(e) if isinstance(x, A.Call) and x.over is not None]


def default_name(item: A.Item) -> str:
    """The name of an unaliased item: its last property, or its text."""
    e = item.expr
    if item.alias:
        return item.alias
    if isinstance(e, A.Prop):
        return e.name
    if isinstance(e, A.Var):
        return e.name
    return item.text


class Compiler:
    """Compiles expressions over one scope."""

    def __init__(self, scope: Scope, params: dict[str, Any] | None = None, replaced: dict[str, str] | None = None, local: dict[str, Column] | None = None, score: dict[str, Callable[..., Column]] | None = None):
        self.scope, self.params = scope, params or {}
        #: Sub-expressions (by their form) that an earlier step has made columns of.
        self.replaced = replaced or {}
        self.local = local or {}
        self.score = score or {}

    def inner(self, **more: Column) -> Compiler:
        return Compiler(self.scope, self.params, self.replaced, self.local | more, self.score)

    def __call__(self, e: A.Expr) -> Column:
        at = self.replaced.get(repr(e))
        if at is not None:
            return quoted(at)
        return getattr(self, "on_" + type(e).__name__.lower())(e)

    # -- names
    def on_lit(self, e: A.Lit) -> Column:
        return lit(e.value)

    def on_var(self, e: A.Var) -> Column:
        if e.name in self.local:
            return self.local[e.name]
        if e.name in self.scope.values:
            return quoted(self.scope.values[e.name])
        if e.name in self.scope.elements:
            return self.whole(self.scope.elements[e.name])
        if e.name in self.scope.paths:
            return self.path(self.scope.paths[e.name])
        raise QueryError(f"unknown name {e.name}")

    def on_ref(self, e: A.Ref) -> Column:
        name = e.name[1:]
        if name in self.params:
            value = self.params[name]
            return value if isinstance(value, Column) else self.constant(value)
        if e.name in self.scope.elements:
            return self.whole(self.scope.elements[e.name])
        raise QueryError(f"unknown parameter {e.name}")

    def constant(self, value: Any) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[self.constant(v) for v in value])
        if isinstance(value, dict):
            return F.struct(*[self.constant(v).alias(k) for k, v in value.items()])
        return lit(value)

    def element(self, e: A.Expr) -> Element | None:
        """The pattern element that an expression names, also as ``a.tag`` or ``$$.tag``."""
        if isinstance(e, A.Var) and e.name not in self.local:
            return self.scope.elements.get(e.name)
        if isinstance(e, A.Ref):
            return self.scope.elements.get(e.name)
        if isinstance(e, A.Prop):
            found = self.element(e.base)
            if found and e.name in found.names and e.name not in found.props:
                return found
        return None

    def on_prop(self, e: A.Prop) -> Column:
        if isinstance(e.base, A.Ref) and e.base.name == "$-":
            if e.name not in self.scope.values:
                raise QueryError(f"the piped result has no column {e.name}")
            return quoted(self.scope.values[e.name])
        found = self.element(e.base)
        if found:
            if e.name in found.props:
                return quoted(found.props[e.name])
            key = {"_vid": "vid", "_src": "src", "_dst": "dst", "_rank": "rank", "_type": "type"}.get(e.name, e.name)
            if key in found.keys:
                return quoted(found.keys[key])
            if key == "type":
                return self.name_of(found)
            raise QueryError(f"no property {e.name} of {'/'.join(found.names) or 'an untyped element'}")
        if isinstance(e.base, A.Var) and not self.scope.known(e.base.name) and e.base.name not in self.local:
            # LOOKUP and GO name the tag or edge type itself.
            if e.name in self.scope.values and not self.scope.elements:
                return quoted(self.scope.values[e.name])
            raise QueryError(f"unknown name {e.base.name}")
        return self(e.base)[e.name]

    def name_of(self, x: Element) -> Column:
        return quoted(x.name_column) if x.name_column else F.lit(x.names[0] if x.names else None)

    def whole(self, x: Element) -> Column:
        """A node or an edge as a struct: keys, tag or type, properties."""
        keys = [quoted(c).alias(k) for k, c in x.keys.items()]
        props = [quoted(c).alias(p) for p, c in x.props.items()]
        return F.struct(*keys, self.name_of(x).alias("tag" if x.kind == "node" else "type"), *props)

    def path(self, p: PathValue) -> Column:
        if p.column:
            return quoted(p.column)
        nodes = [self.scope.elements[n] for n in p.parts if n in self.scope.elements and self.scope.elements[n].kind == "node"]
        edges = [self.scope.elements[n] for n in p.parts if n in self.scope.elements and self.scope.elements[n].kind == "edge"]
        vids = F.array(*[quoted(n.keys["vid"]) for n in nodes])
        steps = F.array(*[self.step(x) for x in edges]) if edges else F.array().cast("array<struct<src:bigint,dst:bigint,rank:bigint,type:string>>")
        return F.struct(vids.alias("nodes"), steps.alias("edges"))

    def step(self, x: Element) -> Column:
        return F.struct(quoted(x.keys["src"]).alias("src"), quoted(x.keys["dst"]).alias("dst"), quoted(x.keys["rank"]).alias("rank"), self.name_of(x).alias("type"))

    # -- operators
    def on_unary(self, e: A.Unary) -> Column:
        if e.op == "NOT":
            return ~self(e.arg)
        if e.op == "IS NULL":
            found = self.element(e.arg)
            return quoted(next(iter(found.keys.values()))).isNull() if found else self(e.arg).isNull()
        if e.op == "IS EMPTY":
            x = self(e.arg)
            return x.isNull() | (F.size(x) == 0 if self.kind(x).startswith(("array", "map")) else x == "")
        return -self(e.arg)

    def kind(self, c: Column) -> str:
        """The type of a Column over this scope, as Spark resolves it; unknown inside a lambda, whose variables have none here."""
        if self.local:
            return ""
        try:
            return self.scope.df.select(c.alias("c")).schema[0].dataType.simpleString()
        except AnalysisException:
            return ""

    def on_binary(self, e: A.Binary) -> Column:
        op = e.op
        if op in ("==", "!="):
            a, b = self.element(e.left), self.element(e.right)
            if a and b:  # elements are equal if their keys are
                same = None
                for k in a.keys:
                    c = quoted(a.keys[k]) == quoted(b.keys[k])
                    same = c if same is None else same & c
                return same if op == "==" else ~same
        left, right = self(e.left), self(e.right)
        if op == "/":
            if self.kind(left) in INTEGRAL and self.kind(right) in INTEGRAL:
                return F.call_function("div", left, right)
            return left / right
        if op == "IN":
            if isinstance(e.right, A.ListLit):
                return left.isin(*[self(x) for x in e.right.items])
            return F.array_contains(right, left)
        if op == "CONTAINS":
            return F.array_contains(left, right) if self.kind(left).startswith("array") else F.contains(left, right)
        if op == "+" and self.kind(left) == "string":
            return F.concat(left, right.cast("string"))
        if op == "+" and self.kind(left).startswith("array"):
            return F.concat(left, right if self.kind(right).startswith("array") else F.array(right))
        simple: dict[str, Callable[[Column, Column], Column]] = {
            "OR": lambda a, b: a | b, "AND": lambda a, b: a & b, "XOR": lambda a, b: a != b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
            "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
            "%": lambda a, b: a % b, "**": F.pow, "||": F.concat, "STARTS": F.startswith, "ENDS": F.endswith, "=~": lambda a, b: F.like(a, b),
            "LIST UNION": F.concat, "LIST INTERSECT": lambda a, b: F.filter(a, lambda x: F.array_contains(b, x)), "LIST EXCEPT": lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x)),
        }
        if op in simple:
            return simple[op](left, right)
        if op in ("->", "->>", "#>", "#>>"):
            key = str(getattr(right, "_weft_literal", ""))
            parts = key.strip("{}").split(",") if op[0] == "#" else [key]
            path = "$" + "".join(f"[{x}]" if x.strip().isdigit() else f".{x.strip()}" for x in parts)
            return F.get_json_object(left, path)
        raise QueryError(f"unknown operator {op}")

    def on_index(self, e: A.Index) -> Column:
        base, i = self(e.base), self(e.index)
        if self.kind(base).startswith("map") or isinstance(getattr(i, "_weft_literal", None), str):
            return base[getattr(i, "_weft_literal", i)]
        return REGISTRY["list_extract"](base, i)

    def on_slice(self, e: A.Slice) -> Column:
        return REGISTRY["list_slice"](self(e.base), self(e.start) if e.start is not None else F.lit(0), self(e.end) if e.end is not None else None)

    def on_case(self, e: A.Case) -> Column:
        subject = self(e.subject) if e.subject is not None else None
        out = None
        for when, then in e.whens:
            test = self(when) if subject is None else subject == self(when)
            out = F.when(test, self(then)) if out is None else out.when(test, self(then))
        return out.otherwise(self(e.otherwise)) if e.otherwise is not None else out

    def on_cast(self, e: A.Cast) -> Column:
        kind = spark_type(e.type)
        return self(e.arg).try_cast(kind) if e.lenient else self(e.arg).cast(kind)

    def on_listlit(self, e: A.ListLit) -> Column:
        out = F.array(*[self(x) for x in e.items])
        if all(isinstance(x, A.Lit) for x in e.items):
            out._weft_literal = [x.value for x in e.items]
        return out

    def on_maplit(self, e: A.MapLit) -> Column:
        return F.struct(*[self(v).alias(k) for k, v in e.items])

    def on_comprehension(self, e: A.Comprehension) -> Column:
        out = self(e.source)
        if e.where is not None:
            out = F.filter(out, lambda x: self.inner(**{e.var: x})(e.where))
        return F.transform(out, lambda x: self.inner(**{e.var: x})(e.result)) if e.result is not None else out

    def on_quantifier(self, e: A.Quantifier) -> Column:
        test = lambda x: self.inner(**{e.var: x})(e.where)
        source = self(e.source)
        if e.kind == "ALL":
            return F.forall(source, test)
        if e.kind == "SINGLE":
            return F.size(F.filter(source, test)) == 1
        found = F.exists(source, test)
        return ~found if e.kind == "NONE" else found

    def on_reduce(self, e: A.Reduce) -> Column:
        init, source = self(e.init), self(e.source)
        kind = self.kind(F.aggregate(source, init, lambda a, x: a)) or None
        item = self.kind(source).removeprefix("array<").removesuffix(">")
        if kind in INTEGRAL and item in (*INTEGRAL, "double", "float"):
            init = init.cast("double" if item in ("double", "float") else "bigint")
        return F.aggregate(source, init, lambda a, x: self.inner(**{e.acc: a, e.var: x})(e.step))

    # -- functions
    def on_call(self, e: A.Call) -> Column:
        if e.over is not None:
            return self.windowed(e)
        if e.name in self.score:
            return self.score[e.name](*e.args)
        special = getattr(self, "fn_" + e.name, None)
        if special:
            out = special(e)
            if out is not None:
                return out
        if is_aggregate_call(e):
            return self.aggregate(e)
        fn = REGISTRY.get(e.name) or CUSTOM.get(e.name)
        if fn is None:
            raise QueryError(f"unknown function {e.name}")
        return fn(*[self(a) for a in e.args])

    def aggregate(self, e: A.Call) -> Column:
        test = self(e.filter) if e.filter is not None else None
        if e.star or not e.args:
            return F.count(F.when(test, 1)) if test is not None else F.count(F.lit(1))
        found = self.element(e.args[0])
        args = [quoted(next(iter(found.keys.values()))) if found else self(e.args[0]), *[self(a) for a in e.args[1:]]]
        if test is not None:
            args[0] = F.when(test, args[0])
        if e.name == "group_concat":
            order = [(F.when(test, self(k)) if test is not None else self(k), up) for k, up in e.within] if e.within else None
            return group_concat(args[0], args[1] if len(args) > 1 else None, e.distinct, order)
        if e.name == "percentile_cont":
            key, _ = (e.within or [(e.args[0], True)])[0]
            share = args[0] if e.within else args[1]
            return F.percentile(F.when(test, self(key)) if test is not None else self(key), share)
        table = DISTINCT if e.distinct else AGGREGATES
        if e.name not in table:
            raise QueryError(f"{e.name}(DISTINCT …) isn't supported")
        return table[e.name](*args)

    def windowed(self, e: A.Call) -> Column:
        spec: WindowSpec = Window.partitionBy(*[self(x) for x in e.over.partition])
        order = [self(k).asc_nulls_first() if up else self(k).desc_nulls_last() for k, up in e.over.order]
        if order:
            spec = spec.orderBy(*order)
        name, args = e.name, [self(a) for a in e.args]
        number = lambda i, default: getattr(args[i], "_weft_literal", default) if len(args) > i else default
        if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
            return getattr(F, name)().over(spec)
        if name == "ntile":
            return F.ntile(number(0, 1)).over(spec)
        if name in ("lead", "lag"):
            return getattr(F, name)(args[0], number(1, 1), number(2, None)).over(spec)
        if name in ("first_value", "last_value", "nth_value"):
            spec = spec.rowsBetween(*FULL)
            if name == "nth_value":
                return F.nth_value(args[0], number(1, 1)).over(spec)
            return (F.first if name == "first_value" else F.last)(args[0]).over(spec)
        if e.over.frame is not None:
            low, high = e.over.frame
            spec = spec.rowsBetween(FULL[0] if low is None else low, FULL[1] if high is None else high)
        return self.aggregate(A.Call(e.name, e.args, e.distinct, e.star, e.filter, e.within)).over(spec)

    def fn_date_add(self, e: A.Call) -> Column | None:
        """A date stays a date; anything else keeps its time of day."""
        day, n = self(e.args[0]), self(e.args[1])
        return F.date_add(day, n.cast("int")) if self.kind(day) == "date" else None

    def fn_date_sub(self, e: A.Call) -> Column | None:
        day, n = self(e.args[0]), self(e.args[1])
        return F.date_sub(day, n.cast("int")) if self.kind(day) == "date" else None

    # -- functions of graph elements and paths
    def _element(self, e: A.Call) -> Element | None:
        return self.element(e.args[0]) if e.args else None

    def fn_id(self, e: A.Call) -> Column | None:
        x = self._element(e)
        return quoted(x.keys["vid"]) if x and x.kind == "node" else self(e.args[0])["vid"]

    def fn_tags(self, e: A.Call) -> Column:
        x = self._element(e)
        if x is None:
            return F.array(self(e.args[0])["tag"])
        return F.array(quoted(x.name_column)) if x.name_column else F.array(*[F.lit(n) for n in x.names])

    fn_labels = fn_tags

    def fn_type(self, e: A.Call) -> Column:
        x = self._element(e)
        return self.name_of(x) if x else self(e.args[0])["type"]

    def fn_src(self, e: A.Call) -> Column:
        x = self._element(e)
        return quoted(x.keys["src"]) if x else self(e.args[0])["src"]

    def fn_dst(self, e: A.Call) -> Column:
        x = self._element(e)
        return quoted(x.keys["dst"]) if x else self(e.args[0])["dst"]

    fn_startnode, fn_endnode = fn_src, fn_dst

    def fn_rank(self, e: A.Call) -> Column:
        x = self._element(e)
        return quoted(x.keys["rank"]) if x else self(e.args[0])["rank"]

    def fn_properties(self, e: A.Call) -> Column | None:
        x = self._element(e)
        return F.struct(*[quoted(c).alias(p) for p, c in x.props.items()]) if x else None

    def fn_keys(self, e: A.Call) -> Column | None:
        x = self._element(e)
        return F.array(*[F.lit(p) for p in sorted(x.props)]) if x else None

    def _path(self, e: A.Call) -> Column | None:
        if e.args and isinstance(e.args[0], A.Var) and e.args[0].name in self.scope.paths:
            return self.path(self.scope.paths[e.args[0].name])
        return None

    def fn_nodes(self, e: A.Call) -> Column:
        p = self._path(e)
        return (p if p is not None else self(e.args[0]))["nodes"]

    def fn_relationships(self, e: A.Call) -> Column:
        p = self._path(e)
        return (p if p is not None else self(e.args[0]))["edges"]

    def fn_length(self, e: A.Call) -> Column | None:
        p = self._path(e)
        return F.size(p["edges"]) if p is not None else None
