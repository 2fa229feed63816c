"""MATCH patterns into joins: one alias a variable, one join a hop, unrolled walks for variable lengths."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.model import EdgeType, GraphSpace
from weftgraph.operators.traversal import directed
from weftgraph.plans.expressions import Compiler, Element, PathValue, Scope, quoted, walk
from weftgraph.runtime import is_empty, settle

_fresh = count()


def conjuncts(e: A.Expr | None) -> list[A.Expr]:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def pattern_names(patterns: list[A.PathPattern]) -> set[str]:
    return {x.var for p in patterns for x in p.elements if x.var}


class Matcher:
    """Translates patterns of one space; ``run_query`` translates subqueries."""

    def __init__(self, space: GraphSpace, params: dict[str, Any], run_query: Any):
        self.space, self.params, self.run_query = space, params, run_query

    # -- entry points
    def match(self, scope: Scope | None, m: A.Match) -> Scope:
        if m.optional and scope is not None:
            return self.optional(scope, m)
        if m.optional and len(m.patterns[0].elements) > 1:
            first = replace(m.patterns[0], elements=m.patterns[0].elements[:1])
            if first.elements[0].var is None:
                first.elements[0].var = f"_v{next(_fresh)}"
            return self.optional(self.paths(None, [first]), m)
        out = self.paths(scope, m.patterns)
        return self.filter(out, m.where)

    def paths(self, scope: Scope | None, patterns: list[A.PathPattern]) -> Scope:
        for p in patterns:
            scope = self.path(scope, p)
        return scope

    def filter(self, scope: Scope, where: A.Expr | None) -> Scope:
        """Conjuncts one by one: subqueries as semi- and anti-joins, the rest as one filter."""
        plain: list[A.Expr] = []
        for c in conjuncts(where):
            negated = isinstance(c, A.Unary) and c.op == "NOT" and isinstance(c.arg, (A.Exists, A.InQuery))
            inner = c.arg if negated else c
            if isinstance(inner, A.Exists):
                scope = self.exists(scope, inner, negated)
            elif isinstance(inner, A.InQuery):
                scope = self.in_query(scope, inner, inner.negated != negated)
            else:
                plain.append(c)
        for c in plain:
            if any(isinstance(x, (A.Exists, A.InQuery)) for x in walk(c)):
                scope = self.nested(scope, c)
        simple = [c for c in plain if not any(isinstance(x, (A.Exists, A.InQuery)) for x in walk(c))]
        if simple:
            compile_ = Compiler(scope, self.params)
            scope = replace(scope, df=scope.df.where(all_of([compile_(c) for c in simple])))
        return scope

    # -- subqueries
    def correlated(self, scope: Scope, patterns: list[A.PathPattern], where: A.Expr | None) -> tuple[Scope, Column]:
        """A pattern on its own, its shared variables renamed, and the condition that ties it to the outer scope."""
        shared = {v: f"_s{next(_fresh)}" for v in pattern_names(patterns) if v in scope.elements}

        def renamed(x: Any) -> Any:
            return replace(x, var=shared.get(x.var, x.var or f"_v{next(_fresh)}"))

        own = [replace(p, elements=[self.labelled(renamed(x), x, scope) for x in p.elements]) for p in patterns]
        inner = self.paths(None, own)
        ties = []
        for old, new in shared.items():
            a, b = scope.elements[old], inner.elements[new]
            ties += [quoted(a.keys[k]) == quoted(b.keys[k]) for k in a.keys]
        merged = Scope(inner.df, scope.values | inner.values, inner.elements | scope.elements)
        compile_ = Compiler(merged, self.params)
        return inner, all_of(ties + [compile_(c) for c in conjuncts(where)])

    @staticmethod
    def labelled(x: Any, old: Any, scope: Scope) -> Any:
        """A shared node keeps the tag it has outside, if it has a single one."""
        if isinstance(x, A.NodePattern) and not x.labels and old.var in scope.elements and scope.elements[old.var].name_column is None:
            return replace(x, labels=list(scope.elements[old.var].names))
        return x

    def exists(self, scope: Scope, e: A.Exists, anti: bool) -> Scope:
        inner, tie = self.correlated(scope, e.pattern, e.where)
        return replace(scope, df=scope.df.join(inner.df, tie, "left_anti" if anti else "left_semi"))

    def member(self, scope: Scope, df: DataFrame, e: A.InQuery) -> tuple[DataFrame, str]:
        """``df`` with a column that holds the three-valued answer of IN: null if the operand or, without a match, some row of the side is null."""
        side = self.run_query(e.query)
        name, flag, facts = f"_q{next(_fresh)}", f"_f{next(_fresh)}", f"_n{next(_fresh)}"
        side = side.select(F.col(side.columns[0]).alias(name)).distinct()
        # One row: whether the side has rows, and nulls among them.
        told = side.agg((F.count("*") > 0).alias(f"{facts}_some"), F.coalesce(F.bool_or(F.col(name).isNull()), F.lit(False)).alias(f"{facts}_null"))
        arg = f"{name}_arg"
        df = df.withColumn(arg, Compiler(replace(scope, df=df), self.params)(e.arg)).join(side.where(F.col(name).isNotNull()), F.col(arg) == F.col(name), "left").crossJoin(F.broadcast(told))
        unknown = F.col(f"{facts}_some") & (F.col(arg).isNull() | F.col(f"{facts}_null"))
        answer = F.when(F.col(name).isNotNull(), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
        return df.withColumn(flag, ~answer if e.negated else answer).drop(name, arg, f"{facts}_some", f"{facts}_null"), flag

    def in_query(self, scope: Scope, e: A.InQuery, anti: bool) -> Scope:
        if not anti:
            side = self.run_query(e.query)
            name = f"_q{next(_fresh)}"
            side = side.select(F.col(side.columns[0]).alias(name))
            return replace(scope, df=scope.df.join(side, Compiler(scope, self.params)(e.arg) == F.col(name), "left_semi"))
        df, flag = self.member(scope, scope.df, replace(e, negated=True))
        return replace(scope, df=df.where(F.col(flag)).drop(flag))

    def nested(self, scope: Scope, e: A.Expr) -> Scope:
        """Subqueries below OR or NOT: each becomes a flag column through a left join on its distinct keys."""
        df, replaced = scope.df, {}
        for x in walk(e):
            if isinstance(x, A.Exists):
                inner, tie = self.correlated(scope, x.pattern, x.where)
                flag = f"_f{next(_fresh)}"
                hit = df.join(inner.df, tie, "left_semi").select(*[quoted(c).alias(f"{flag}_{c}") for c in df.columns]).distinct()
                on = all_of([quoted(c).eqNullSafe(quoted(f"{flag}_{c}")) for c in df.columns])
                hit = hit.withColumn(flag, F.lit(True))
                df = df.join(hit, on, "left").select(*[quoted(c) for c in df.columns], F.coalesce(flag, F.lit(False)).alias(flag))
                replaced[repr(x)] = flag
            elif isinstance(x, A.InQuery):
                df, flag = self.member(scope, df, x)
                replaced[repr(x)] = flag
        return replace(scope, df=df.where(Compiler(replace(scope, df=df), self.params, replaced)(e)))

    def optional(self, scope: Scope, m: A.Match) -> Scope:
        """Left join of the pattern on its shared variables; WHERE is part of the join's condition."""
        names = {x.var for p in m.patterns for x in p.elements if x.var and x.var not in scope.elements}
        inner, tie = self.correlated(scope, m.patterns, m.where)
        df = scope.df.join(inner.df, tie, "left")
        kept = {v: e for v, e in inner.elements.items() if v in names}
        return Scope(df, scope.values | {k: c for k, c in inner.values.items() if k in names}, scope.elements | kept, scope.paths, scope.piped)

    # -- nodes
    def node_table(self, var: str, labels: list[str]) -> tuple[DataFrame, Element]:
        if len(labels) == 1:
            tag = self.space.tag(labels[0])
            df = tag.live()
            props = {c: f"{var}__{c}" for c in tag.props}
            return df.select(F.col("vid").alias(f"{var}__vid"), *[quoted(c).alias(n) for c, n in props.items()]), Element("node", {"vid": f"{var}__vid"}, props, labels)
        if labels:  # all of them
            df, props = None, {}
            for label in labels:
                tag = self.space.tag(label)
                new = {c: f"{var}__{c}" for c in tag.props if c not in props}
                side = tag.live().select(F.col("vid").alias(f"{var}__vid"), *[quoted(c).alias(n) for c, n in new.items()])
                df = side if df is None else df.join(side, f"{var}__vid")
                props |= new
            return df, Element("node", {"vid": f"{var}__vid"}, props, labels)
        tags = list(self.space.tags.values())
        if not tags:
            raise QueryError("the space has no tags")
        uniform = len({t.df.schema["vid"].dataType.simpleString() for t in tags}) == 1
        kinds: dict[str, set[str]] = {}
        for t in tags:
            for f in t.df.schema:
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())

        def side(t: Any) -> DataFrame:
            vid = F.col("vid") if uniform else F.col("vid").cast("string")
            props = [(quoted(c) if len(kinds[c]) == 1 else quoted(c).cast("string")).alias(f"{var}__{c}") for c in t.props]
            return t.live().select(vid.alias(f"{var}__vid"), F.lit(t.name).alias(f"{var}__tag"), *props)

        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(side, tags))
        props = {c.removeprefix(f"{var}__"): c for c in df.columns if c not in (f"{var}__vid", f"{var}__tag")}
        return df, Element("node", {"vid": f"{var}__vid"}, props, [t.name for t in tags], f"{var}__tag")

    def narrowed(self, scope: Scope, x: A.NodePattern | A.EdgePattern, var: str) -> Scope:
        """Inline properties as equalities."""
        if not x.props:
            return scope
        compile_ = Compiler(scope, self.params)
        return replace(scope, df=scope.df.where(all_of([compile_(A.Binary("==", A.Prop(A.Var(var), k), v)) for k, v in x.props])))

    def add_node(self, scope: Scope | None, x: A.NodePattern, var: str) -> Scope:
        df, element = self.node_table(var, x.labels)
        out = Scope(df, {}, {var: element})
        out = self.narrowed(out, x, var)
        if scope is None:
            return out
        return Scope(scope.df.crossJoin(out.df), scope.values, scope.elements | {var: element}, scope.paths, scope.piped)

    # -- paths
    def path(self, scope: Scope | None, p: A.PathPattern) -> Scope:
        elements = [replace(x, var=x.var or f"_v{next(_fresh)}") for x in p.elements]
        named = {x.var for x in p.elements if x.var}
        bound = [i for i in range(0, len(elements), 2) if scope is not None and elements[i].var in scope.elements]
        if bound:
            start = bound[0]
            scope = self.narrowed(self.relabelled(scope, elements[start]), elements[start], elements[start].var)
        elif scope is not None and len(elements) > 1:
            # Not tied to what is matched so far: on its own first, then all combinations (WHERE may make it a join).
            own = self.path(None, replace(p, elements=elements))
            return Scope(scope.df.crossJoin(own.df), scope.values | own.values, scope.elements | own.elements, scope.paths | own.paths, scope.piped)
        else:
            start = self.start(elements)
            scope = self.add_node(scope, elements[start], elements[start].var)
        for i in range(start, len(elements) - 1, 2):
            scope = self.hop(scope, elements[i], elements[i + 1], elements[i + 2], named)
        for i in range(start, 0, -2):
            e = elements[i - 1]
            flipped = replace(e, direction={"out": "in", "in": "out"}.get(e.direction, "both"))
            scope = self.hop(scope, elements[i], flipped, elements[i - 2], named, reverse=True)
        if p.var:
            scope = self.bind_path(scope, p.var, elements)
        return scope

    @staticmethod
    def start(elements: list[Any]) -> int:
        """The end with more inline properties, then with a label: the more selective scan begins."""
        ends = [0, len(elements) - 1]
        return max(ends, key=lambda i: (len(elements[i].props), bool(elements[i].labels), -i))

    def relabelled(self, scope: Scope, x: A.NodePattern) -> Scope:
        """Further labels of a bound node as semi-joins."""
        have = scope.elements[x.var]
        for label in x.labels:
            if have.name_column:
                scope = replace(scope, df=scope.df.where(quoted(have.name_column) == label))
            elif label not in have.names:
                other = self.space.tag(label).live().select(F.col("vid").alias(f"_l{next(_fresh)}"))
                scope = replace(scope, df=scope.df.join(other, quoted(have.keys["vid"]) == F.col(other.columns[0]), "left_semi"))
        return scope

    def candidates(self, left: Element, e: A.EdgePattern, labels: list[str]) -> list[EdgeType]:
        kinds = [self.space.edge(t) for t in e.types] if e.types else list(self.space.edges.values())
        if e.types:
            return kinds

        def fits(k: EdgeType) -> bool:
            ways = [(k.src_tag, k.dst_tag)] if e.direction == "out" else [(k.dst_tag, k.src_tag)] if e.direction == "in" else [(k.src_tag, k.dst_tag), (k.dst_tag, k.src_tag)]
            return any((a is None or not left.names or a in left.names) and (b is None or not labels or b in labels) for a, b in ways)

        return [k for k in kinds if fits(k)]

    def edge_side(self, kinds: list[EdgeType], direction: str, var: str) -> tuple[DataFrame, Element]:
        """Directed edges of some types with all columns under the variable's prefix."""
        uniform = len({k.df.schema[c].dataType.simpleString() for k in kinds for c in ("src", "dst")}) == 1

        def one(k: EdgeType) -> DataFrame:
            key = (lambda c: F.col(c)) if uniform else (lambda c: F.col(c).cast("string"))
            base = k.live().select(key("src").alias("src"), key("dst").alias("dst"), "rank", F.lit(k.name).alias("type"), F.lit(k.src_tag).alias("src_tag"), F.lit(k.dst_tag).alias("dst_tag"), *[quoted(c).alias(f"p_{c}") for c in k.props])
            out = directed(base, direction)
            forward = (F.col("here") == F.col("src")) if direction == "both" else F.lit(direction == "out")
            return out.withColumns({"here_tag": F.when(forward, F.col("src_tag")).otherwise(F.col("dst_tag")), "there_tag": F.when(forward, F.col("dst_tag")).otherwise(F.col("src_tag"))})

        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, kinds))
        props = {c.removeprefix("p_"): f"{var}__{c.removeprefix('p_')}" for c in df.columns if c.startswith("p_")}
        keys = {k: f"{var}__{k}" for k in ("src", "dst", "rank")}
        columns = [F.col(k).alias(n) for k, n in keys.items()] + [F.col(f"p_{c}").alias(n) for c, n in props.items()]
        df = df.select(*columns, F.col("type").alias(f"{var}__type"), *[F.col(c).alias(f"{var}__{c}") for c in ("here", "there", "here_tag", "there_tag")])
        return df, Element("edge", keys, props, [k.name for k in kinds], f"{var}__type" if len(kinds) > 1 else None)

    def hop(self, scope: Scope, left: A.NodePattern, e: A.EdgePattern, right: A.NodePattern, named: set[str], reverse: bool = False) -> Scope:
        at = scope.elements[left.var]
        bound = scope.elements.get(right.var)
        labels = right.labels or (list(bound.names) if bound and not bound.name_column else [])
        kinds = self.candidates(at, e, labels)
        if not kinds:
            raise QueryError(f"no edge type joins {'/'.join(at.names)} to {'/'.join(labels) or 'anything'}")
        side, element = self.edge_side(kinds, e.direction, e.var)
        v = e.var
        several = bool(at.name_column) or len(kinds) > 1
        if e.hops is None:
            mixed = at.name_column and any(k.src_tag or k.dst_tag for k in kinds)
            on = self.same_key(scope, at, side, f"{v}__here")
            if mixed:
                on = on & (F.col(f"{v}__here_tag").isNull() | (quoted(at.name_column) == F.col(f"{v}__here_tag")))
            elif several and len(at.names) == 1:
                on = on & (F.col(f"{v}__here_tag").isNull() | (F.col(f"{v}__here_tag") == at.names[0]))
            out = Scope(scope.df.join(side, on), scope.values, scope.elements | {v: element}, scope.paths, scope.piped)
            if e.props:
                out = self.narrowed(out, e, v)
        else:
            out = self.walks(scope, at, e, side, v, reverse)
        return self.arrive(out, right, v, kinds, e.direction, named)

    @staticmethod
    def same_key(scope: Scope, at: Element, side: DataFrame, column: str) -> Column:
        a, b = scope.df.schema[at.keys["vid"]].dataType, side.schema[column].dataType
        left, right = quoted(at.keys["vid"]), F.col(column)
        return left == right if a == b else left.cast("string") == right.cast("string")

    def arrive(self, scope: Scope, right: A.NodePattern, v: str, kinds: list[EdgeType], direction: str, named: set[str]) -> Scope:
        there = f"{v}__there"
        if right.var in scope.elements:
            node = scope.elements[right.var]
            out = replace(scope, df=scope.df.where(self.same_key(scope, node, scope.df, there)))
            return self.narrowed(self.relabelled(out, right), right, right.var)
        ends = {k.dst_tag for k in kinds} if direction == "out" else {k.src_tag for k in kinds} if direction == "in" else {t for k in kinds for t in (k.src_tag, k.dst_tag)}
        labels = right.labels or ([next(iter(ends))] if len(ends) == 1 and None not in ends else [])
        if right.var not in named and not right.labels and not right.props:
            # Nothing is asked of the vertex: its key from the edge will do.
            element = Element("node", {"vid": there}, {}, labels)
            return replace(scope, elements=scope.elements | {right.var: element})
        df, element = self.node_table(right.var, labels)
        own = self.narrowed(Scope(df, {}, {right.var: element}), right, right.var)
        on = self.same_key(own, element, scope.df, there)
        if element.name_column and f"{v}__there_tag" in scope.df.columns:
            on = on & (F.col(f"{v}__there_tag").isNull() | (quoted(element.name_column) == F.col(f"{v}__there_tag")))
        elif len(ends) > 1 and labels and f"{v}__there_tag" in scope.df.columns:
            on = on & (F.col(f"{v}__there_tag").isNull() | (F.col(f"{v}__there_tag") == labels[0]))
        return Scope(scope.df.join(own.df, on), scope.values, scope.elements | {right.var: element}, scope.paths, scope.piped)

    def walks(self, scope: Scope, at: Element, e: A.EdgePattern, side: DataFrame, v: str, reverse: bool) -> Scope:
        """Variable length: walks without repeated edges from the distinct vertices reached so far, joined back on them."""
        if e.props:
            side = self.narrowed(Scope(side, {}, {v: Element("edge", {k: f"{v}__{k}" for k in ("src", "dst", "rank")}, {c.removeprefix(f"{v}__"): c for c in side.columns}, e.types)}), e, v).df
        low, high = e.hops
        step = F.struct(*[F.col(f"{v}__{k}").alias(k) for k in ("src", "dst", "rank", "type")])
        hops = side.select(*[F.col(f"{v}__{k}").alias(k) for k in ("here", "there", "here_tag", "there_tag")], step.alias("e"))
        kind = f"array<{hops.schema['e'].dataType.simpleString()}>"
        key = quoted(at.keys["vid"]).cast(hops.schema["here"].dataType)
        # Keys are a tag's own: an edge goes on from a vertex of the tag that it starts at, where both are known.
        tag = quoted(at.name_column) if at.name_column else F.lit(at.names[0] if len(at.names) == 1 else None).cast("string")
        now = scope.df.select(key.alias("start"), tag.alias("at_tag")).distinct()
        now = now.select("start", F.col("start").alias("at"), "at_tag", F.array("start").alias("nodes"), F.array().cast(kind).alias("edges"))
        same_tag = F.col("at_tag").isNull() | F.col("here_tag").isNull() | (F.col("at_tag") == F.col("here_tag"))
        found = [now] if low == 0 else []
        for n in count(1) if high is None else range(1, high + 1):  # edges don't repeat, so walks end
            grown = now.join(hops, (F.col("at") == F.col("here")) & same_tag & ~F.array_contains("edges", F.col("e")))
            now = grown.select("start", F.col("there").alias("at"), F.col("there_tag").alias("at_tag"), F.array_append("nodes", F.col("there")).alias("nodes"), F.array_append("edges", F.col("e")).alias("edges"))
            if high is None or n % 3 == 0:
                now = settle(now, "walks")
                if is_empty(now):
                    break
            if n >= low:
                found.append(now)
        every = reduce(DataFrame.unionByName, found)
        nodes, edges = (F.reverse("nodes"), F.reverse("edges")) if reverse else (F.col("nodes"), F.col("edges"))
        every = every.select(F.col("start").alias(f"{v}__start"), F.col("at").alias(f"{v}__there"), nodes.alias(f"{v}__nodes"), edges.alias(f"{v}__edges"))
        df = scope.df.join(every, quoted(at.keys["vid"]).cast(hops.schema["here"].dataType) == F.col(f"{v}__start"))
        return Scope(df, scope.values | {v: f"{v}__edges"}, scope.elements, scope.paths, scope.piped)

    def bind_path(self, scope: Scope, name: str, elements: list[Any]) -> Scope:
        """The path as a struct of vertex keys and edges."""
        compile_ = Compiler(scope, self.params)
        nodes = [F.array(quoted(scope.elements[elements[0].var].keys["vid"]))]
        edges: list[Column] = []
        for e, n in zip(elements[1::2], elements[2::2], strict=True):
            if e.hops is None:
                nodes.append(F.array(quoted(scope.elements[n.var].keys["vid"])))
                edges.append(F.array(compile_.step(scope.elements[e.var])))
            else:
                walked = F.col(f"{e.var}__nodes")
                nodes.append(F.slice(walked, F.lit(2), F.size(walked)))
                edges.append(F.col(f"{e.var}__edges"))
        steps = F.concat(*edges) if edges else F.array().cast("array<struct<src:bigint,dst:bigint,rank:bigint,type:string>>")
        column = f"{name}__path"
        df = scope.df.withColumn(column, F.struct(F.concat(*nodes).alias("nodes"), steps.alias("edges")))
        return replace(scope, df=df, paths=scope.paths | {name: PathValue(column=column)})
