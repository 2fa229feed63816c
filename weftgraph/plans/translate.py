"""Statements into DataFrames."""

from __future__ import annotations

from dataclasses import replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.aggregate import VECTOR
from weftgraph.functions.scalar import literal
from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.model import GraphSpace
from weftgraph.operators import paths, relational, search, textindex
from weftgraph.operators.traversal import directed, edge_table, edge_types, expand
from weftgraph.plans.changes import Changes
from weftgraph.plans.expressions import Compiler, Element, Scope, aggregates, default_name, plain, quoted, walk, windows
from weftgraph.plans.graphcalls import NAMES as GRAPH_FUNCTIONS
from weftgraph.plans.graphcalls import GraphCalls, has_calls
from weftgraph.plans.patterns import Matcher
from weftgraph.runtime import settle

_fresh = count()


def unique(names: list[str]) -> list[str]:
    """Repeated output names get a number."""
    out: list[str] = []
    for n in names:
        new, i = n, 1
        while new in out:
            new, i = f"{n}_{i}", i + 1
        out.append(new)
    return out


class Translator:
    def __init__(self, space: GraphSpace, params: dict[str, Any] | None = None, variables: dict[str, DataFrame] | None = None):
        self.space, self.params, self.variables = space, params or {}, variables if variables is not None else {}
        self.matcher = Matcher(space, self.params, self.query)

    # -- composition
    def query(self, q: A.Query) -> DataFrame:
        out = self.pipe(q.first)
        for op, stmts in q.rest:
            side = self.pipe(stmts)
            kind, every = op.split(" ")[0], op.endswith("ALL")
            if kind == "UNION":
                out = relational.union(out, side, distinct=not every)
            elif kind == "INTERSECT":
                out = relational.intersect(out, side, multiset=every)
            else:
                out = relational.minus(out, side, multiset=every)
        return out

    def pipe(self, stmts: list[Any]) -> DataFrame:
        out: DataFrame | None = None
        for s in stmts:
            out = getattr(self, "on_" + type(s).__name__.lower())(s, out)
        return out

    def compiler(self, scope: Scope, **kw: Any) -> Compiler:
        return Compiler(scope, self.params, **kw)

    def one_row(self) -> DataFrame:
        return self.space.spark.range(1).select(F.lit(1).alias("__one"))

    def constant(self, e: A.Expr | None) -> Any:
        """The value of a constant expression; parameters count as constants."""
        if e is None:
            return None
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Ref) and e.name[1:] in self.params:
            return self.params[e.name[1:]]
        return self.one_row().select(self.compiler(plain(self.one_row()))(e)).first()[0]

    # -- clauses
    def on_cypher(self, s: A.Cypher, piped: DataFrame | None) -> DataFrame:
        scope = plain(piped, piped=True) if piped is not None else None
        out: DataFrame | None = None
        for i, c in enumerate(s.clauses):
            if isinstance(c, A.Match):
                scope = self.matcher.match(scope, c)
            elif isinstance(c, A.Unwind):
                scope = self.unwind(scope or plain(self.one_row()), c)
            elif isinstance(c, A.Projection):
                if scope is None:
                    scope = Scope(self.one_row())
                if c.scope:
                    scope = self.with_(scope, c)
                else:
                    out = self.project(scope, c)
                    scope = plain(out)
            else:
                out = Changes(self).clause(scope, c, s.clauses[i + 1 :])
        if out is None:
            if scope is None:
                raise QueryError("nothing to return")
            out = scope.df
        return out

    def unwind(self, scope: Scope, c: A.Unwind) -> Scope:
        value = self.compiler(scope)(c.expr)
        is_list = self.compiler(scope).kind(value).startswith("array")
        name = c.var if c.var not in scope.df.columns else f"{c.var}_{next(_fresh)}"
        df = relational.unwind(scope.df, value, name, is_list)
        return replace(scope, df=df, values=scope.values | {c.var: name})

    def with_(self, scope: Scope, p: A.Projection) -> Scope:
        """A projection that elements pass through with all their columns."""
        items = p.items or []
        if any(i.text == "*" for i in items):
            items = [A.Item(A.Var(n), n, n) for n in (*scope.values, *scope.elements, *scope.paths)] + [i for i in items if i.text != "*"]
        carried = {default_name(i): scope.elements[i.expr.name] for i in items if isinstance(i.expr, A.Var) and i.expr.name in scope.elements}
        rest = [i for i in items if not (isinstance(i.expr, A.Var) and i.expr.name in scope.elements)]
        extra, kept = [], {}
        for name, e in carried.items():
            columns = [*e.keys.values(), *e.props.values(), *([e.name_column] if e.name_column else [])]
            extra += [c for c in columns if c not in extra]
            kept[name] = e
        first_keys = [k for e in carried.values() for k in (*e.keys.values(), *([e.name_column] if e.name_column else []))]
        out = self.project(scope, replace(p, items=rest), extra=extra, extra_keys=first_keys)
        values = {c: c for c in out.columns if c not in extra}
        return Scope(out, values, kept)

    # -- projection
    def project(self, scope: Scope, p: A.Projection, extra: list[str] | None = None, extra_keys: list[str] | None = None, score: dict | None = None) -> DataFrame:
        extra = extra or []
        items = []
        for i in p.items or []:
            if i.text == "*":
                names = [n for n in (*scope.values, *scope.elements, *scope.paths) if not n.startswith(("_", "$")) or n == "_"]
                items += [A.Item(A.Var(n), n, n) for n in names]
            else:
                items.append(i)
        names = unique([default_name(i) for i in items])
        if has_calls([i.expr for i in items]) or has_calls([e for e, _ in p.order]) or has_calls(p.where) or has_calls(p.having) or has_calls(p.group):
            items = [replace(i, alias=i.alias or n) for i, n in zip(items, names, strict=True)]
            calls = GraphCalls(self.space, scope, self.compiler(scope))
            items, p = self.swapped(items, calls), self.swapped(replace(p, items=None), calls)
            scope = calls.scope
        aliases = {n: i.expr for n, i in zip(names, items, strict=True) if i.alias}
        if p.where is not None and aggregates(self.known_as(p.where, aliases, scope)):
            p = replace(p, where=None, having=p.where)
        if p.where is not None:
            scope = self.where(scope, p.where, aliases, score)
        wanted = [i.expr for i in items] + [e for e, _ in p.order] + ([p.having] if p.having is not None else [])
        replaced: dict[str, str] = {}
        if p.group is not None or any(aggregates(self.known_as(e, aliases, scope)) for e in wanted):
            scope, replaced, extra = self.aggregate(scope, p, items, aliases, extra, extra_keys or [], score)
        compile_ = self.compiler(scope, replaced=replaced, score=score or {})
        columns = [compile_(i.expr).alias(n) for i, n in zip(items, names, strict=True)]
        order = self.order_columns(compile_, p.order, aliases, names)
        hidden = [c.alias(f"__o{k}") for k, (c, _) in enumerate(order)]
        having, having_hidden = None, []
        if p.having is not None:
            flag = compile_(self.known_as(p.having, aliases, scope))
            having, having_hidden = F.col("__having"), [flag.alias("__having")]
        df = scope.df.select(*columns, *[quoted(c) for c in extra], *hidden, *having_hidden)
        if having is not None:
            df = df.where(having)
        final = [quoted(n) for n in [*names, *extra]]
        if p.distinct:
            df = df.select(*final).distinct() if not order else df.groupBy(*final).agg(*[F.min(f"__o{k}").alias(f"__o{k}") for k in range(len(order))])
        if order:
            df = df.orderBy(*[F.col(f"__o{k}").asc_nulls_first() if up else F.col(f"__o{k}").desc_nulls_last() for k, (_, up) in enumerate(order)])
        return self.cut(df, p.skip, p.limit).select(*final)

    @classmethod
    def swapped(cls, x: Any, calls: GraphCalls) -> Any:
        """Anything of a syntax tree with its graph functions replaced by the columns that hold their values."""
        if isinstance(x, (list, tuple)):
            return type(x)(cls.swapped(y, calls) for y in x)
        if not hasattr(x, "__dataclass_fields__") or isinstance(x, (A.Exists, A.InQuery)):
            return x
        if isinstance(x, A.Call) and x.name in GRAPH_FUNCTIONS and x.over is None:
            return calls.call(x)
        return replace(x, **{k: cls.swapped(getattr(x, k), calls) for k in x.__dataclass_fields__})

    @staticmethod
    def known_as(e: A.Expr, aliases: dict[str, A.Expr], scope: Scope) -> A.Expr:
        """An expression with output names that the scope lacks replaced by what they stand for."""

        def swap(x: Any) -> Any:
            if isinstance(x, A.Var) and x.name in aliases and not scope.known(x.name):
                return aliases[x.name]
            if isinstance(x, A.Prop) and isinstance(x.base, A.Ref) and x.base.name == "$-" and x.name in aliases and x.name not in scope.values:
                return aliases[x.name]
            if isinstance(x, list):
                return [swap(y) for y in x]
            if isinstance(x, tuple):
                return tuple(swap(y) for y in x)
            if hasattr(x, "__dataclass_fields__") and not isinstance(x, (A.Exists, A.InQuery)):
                return replace(x, **{k: swap(getattr(x, k)) for k in x.__dataclass_fields__})
            return x

        return swap(e)

    def where(self, scope: Scope, e: A.Expr, aliases: dict[str, A.Expr], score: dict | None) -> Scope:
        full = self.known_as(e, aliases, scope)
        if score:
            return replace(scope, df=scope.df.where(self.compiler(scope, score=score)(full)))
        return self.matcher.filter(scope, full)

    def order_columns(self, compile_: Compiler, order: list[tuple[A.Expr, bool]], aliases: dict[str, A.Expr], names: list[str]) -> list[tuple[Column, bool]]:
        out = []
        for e, up in order:
            name = e.name if isinstance(e, (A.Var, A.Prop)) else None
            if isinstance(e, A.Prop) and not (isinstance(e.base, A.Ref) and e.base.name == "$-"):
                name = None
            source = aliases.get(name) if name else None
            out.append((compile_(source if source is not None else self.known_as(e, aliases, compile_.scope)), up))
        return out

    def cut(self, df: DataFrame, skip: A.Expr | None, limit: A.Expr | None) -> DataFrame:
        if skip is not None:
            df = df.offset(int(self.constant(skip)))
        return df.limit(int(self.constant(limit))) if limit is not None else df

    def aggregate(self, scope: Scope, p: A.Projection, items: list[A.Item], aliases: dict[str, A.Expr], extra: list[str], extra_keys: list[str], score: dict | None):
        """One aggregate for all items; keys are GROUP BY's, else the items without an aggregate."""
        compile_ = self.compiler(scope, score=score or {})
        keys = [self.known_as(e, aliases, scope) for e in p.group] if p.group is not None else [i.expr for i in items if not aggregates(i.expr) and not windows(i.expr) and not isinstance(i.expr, A.Lit)]
        wanted = [i.expr for i in items] + [self.known_as(e, aliases, scope) for e, _ in p.order] + ([self.known_as(p.having, aliases, scope)] if p.having is not None else [])
        calls: dict[str, A.Call] = {}
        for e in wanted:
            for c in aggregates(e):
                calls.setdefault(repr(c), c)
        replaced = {repr(e): f"__k{n}" for n, e in enumerate(keys)}
        replaced |= {r: f"__a{n}" for n, r in enumerate(calls)}
        df = scope.df.withColumns({f"__k{n}": compile_(e) for n, e in enumerate(keys)}) if keys else scope.df
        key_names = [*[f"__k{n}" for n in range(len(keys))], *extra_keys]
        vectors = [(c.name, replaced[r], c) for r, c in calls.items() if c.name in VECTOR]
        aggs = [compile_(c).alias(replaced[r]) for r, c in calls.items() if c.name not in VECTOR]
        carried = [F.first(quoted(c)).alias(c) for c in extra if c not in extra_keys]
        if p.grouping is not None:
            at = [repr(k) for k in keys]
            sets = [[f"__k{at.index(repr(self.known_as(e, aliases, scope)))}" for e in s] for s in p.grouping[1]]
            grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in key_names]).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
        elif aggs or carried or not vectors:
            grouped = df.groupBy(*map(quoted, key_names)).agg(*(aggs + carried or [F.count(F.lit(1)).alias("__n")]))
        else:
            grouped = None
        for name, out, c in vectors:
            source = df.withColumn("__v", compile_(c.args[0]))
            one = relational.aggregate_vectors(source, key_names, [(name, "__v", out)])
            if grouped is None:
                grouped = one
            elif key_names:
                grouped = relational.join(grouped, one, [(k, k) for k in key_names], "left", null_safe=True).select(*grouped.columns, out)
            else:
                grouped = grouped.crossJoin(one)
        values = {n: c for n, c in scope.values.items() if c in grouped.columns}
        values |= {e.name: f"__k{n}" for n, e in enumerate(keys) if isinstance(e, A.Var)}
        return Scope(grouped, values, {}, {}, scope.piped), replaced, extra

    # -- pipes
    def on_tail(self, s: A.Tail, piped: DataFrame | None) -> DataFrame:
        if piped is None:
            raise QueryError("this clause needs a result piped into it")
        scope = plain(piped, piped=True)
        if s.where is not None:
            scope = self.matcher.filter(scope, s.where)
        df = scope.df
        if s.sample is not None:
            df = relational.sample(df, s.sample)
        if s.order:
            compile_ = self.compiler(scope)
            df = df.orderBy(*[compile_(e).asc_nulls_first() if up else compile_(e).desc_nulls_last() for e, up in s.order])
        return self.cut(df, s.skip, s.limit)

    def on_groupby(self, s: A.GroupBy, piped: DataFrame | None) -> DataFrame:
        if piped is None:
            raise QueryError("GROUP BY needs a result piped into it")
        return self.project(plain(piped, piped=True), s.result)

    def source_ids(self, exprs: list[A.Expr], piped: DataFrame | None, kind: Any) -> DataFrame:
        """Vertex ids as a one-column table: constants, parameters (also lists) or a column of the piped result."""
        if piped is not None and len(exprs) == 1 and (isinstance(exprs[0], (A.Prop, A.Var))):
            e = exprs[0]
            return piped.select(self.compiler(plain(piped, piped=True))(e).cast(kind).alias("vid"))
        if len(exprs) == 1 and isinstance(exprs[0], A.Prop) and isinstance(exprs[0].base, A.Ref):
            table = self.variables.get(exprs[0].base.name[1:])
            if table is not None:
                return table.select(quoted(exprs[0].name).cast(kind).alias("vid"))
        compile_ = self.compiler(plain(self.one_row()))
        parts = []
        for e in exprs:
            c = compile_(e)
            parts.append(c.cast(f"array<{kind.simpleString()}>") if compile_.kind(c).startswith("array") else F.array(c.cast(kind)))
        return self.one_row().select(F.explode(F.concat(*parts)).alias("vid"))

    # -- traversal
    def on_go(self, s: A.Go, piped: DataFrame | None) -> DataFrame:
        kinds = edge_types(self.space, s.types)
        table = edge_table(self.space, [k.name for k in kinds])
        seen = directed(table, s.direction)
        ids = self.source_ids(s.sources, piped, table.schema["src"].dataType)
        if s.low < 1:
            raise QueryError("GO takes at least one step")
        uses_input = piped is not None and s.high == 1 and any(isinstance(x, A.Ref) and x.name == "$-" for x in walk([s.where, s.result.items if s.result else None]))
        values: dict[str, str] = {}
        if uses_input:
            side = piped.withColumnsRenamed({c: f"__in_{c}" for c in piped.columns})
            key = self.compiler(Scope(side, {c: f"__in_{c}" for c in piped.columns}, piped=True))(s.sources[0])
            df = side.join(seen, key.cast(table.schema["src"].dataType) == F.col("here")).withColumn("step", F.lit(1))
            values = {c: f"__in_{c}" for c in piped.columns}
        else:
            df = expand(seen, ids, s.low, s.high)
        props = {c: c for c in table.columns if c not in ("src", "dst", "rank", "type")}
        edge = Element("edge", {"src": "src", "dst": "dst", "rank": "rank"}, props, [k.name for k in kinds], "type")
        elements = {"edge": edge} | {k.name: edge for k in kinds}
        ends = {
            "$^": ("here", {k.dst_tag if s.direction == "in" else k.src_tag for k in kinds}),
            "$$": ("there", {k.src_tag if s.direction == "in" else k.dst_tag for k in kinds}),
        }
        asked = [s.where, s.result]
        for ref, (column, tags) in ends.items():
            alias = {"$^": "source", "$$": "target"}[ref]
            used = [x for x in walk(asked) if isinstance(x, A.Prop) and self.root(x) in (ref, alias)]
            named = {x.name for x in walk(asked) if isinstance(x, A.Prop) and isinstance(x.base, (A.Ref, A.Var)) and x.base.name in (ref, alias) and x.name in self.space.tags}
            element = Element("node", {"vid": column}, {}, [])
            if used:
                tag = self.space.tag(sorted(named)[0] if named else self.single(tags, ref))
                prefix = f"__{alias}_"
                side = tag.live().select(*[quoted(c).alias(prefix + c) for c in tag.df.columns])
                df = df.join(side, F.col(column) == F.col(prefix + "vid").cast(df.schema[column].dataType), "left")
                element = Element("node", {"vid": column}, {c: prefix + c for c in tag.props}, [tag.name])
            elements |= {ref: element, alias: element}
        scope = Scope(df, values | {"dst": "there", "src": "here", "rank": "rank", "step": "step"}, elements, piped=True)
        scope = self.matcher.filter(scope, s.where)
        result = s.result or A.Projection([A.Item(A.Var("dst"), "dst", "dst"), A.Item(A.Var("edge"), "edge", "edge")])
        if s.high > 1 and not any(aggregates(i.expr) for i in result.items or []):
            result = replace(result, distinct=True)
        return self.project(scope, result)

    @staticmethod
    def root(e: A.Expr) -> str | None:
        while isinstance(e, A.Prop):
            e = e.base
        return e.name if isinstance(e, (A.Ref, A.Var)) else None

    @staticmethod
    def single(tags: set, ref: str) -> str:
        found = {t for t in tags if t}
        if len(found) != 1:
            raise QueryError(f"name the tag of {ref}: its vertices are of {sorted(found) or 'unknown tags'}")
        return found.pop()

    def on_fetch(self, s: A.Fetch, piped: DataFrame | None) -> DataFrame:
        if s.edges:
            edge = self.space.edge(s.names[0])
            df = edge.live()
            test = F.lit(False)
            for src, dst, rank in s.edges:
                c = (F.col("src") == self.constant(src)) & (F.col("dst") == self.constant(dst))
                test = test | (c & (F.col("rank") == (self.constant(rank) if rank is not None else 0)))
            scope = self.edge_scope(edge, df.where(test))
            return self.project(scope, s.result) if s.result else scope.df
        names = list(self.space.tags) if s.names == ["*"] else s.names
        out = None
        for name in names:
            tag = self.space.tag(name)
            ids = self.source_ids(s.ids, piped, tag.df.schema["vid"].dataType)
            constant = piped is None and not any(isinstance(x, A.Prop) for x in s.ids)
            df = tag.live()
            if constant:
                found = [self.constant(e) for e in s.ids]
                flat = [y for x in found for y in (x if isinstance(x, (list, tuple)) else [x])]
                df = df.where(F.col("vid").isin(flat))
            else:
                df = df.join(ids.distinct(), "vid", "left_semi")
            scope = self.tag_scope(tag, df)
            one = self.project(scope, s.result) if s.result else (df if len(names) == 1 else df.select("vid", F.lit(name).alias("tag"), F.to_json(F.struct(*tag.props)).alias("properties")))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def tag_scope(self, tag: Any, df: DataFrame) -> Scope:
        element = Element("node", {"vid": "vid"}, {c: c for c in tag.props}, [tag.name])
        return Scope(df, {c: c for c in df.columns}, {tag.name: element, "vertex": element, "$^": element})

    def edge_scope(self, edge: Any, df: DataFrame) -> Scope:
        element = Element("edge", {"src": "src", "dst": "dst", "rank": "rank"}, {c: c for c in edge.props}, [edge.name])
        return Scope(df, {c: c for c in df.columns}, {edge.name: element, "edge": element})

    def on_lookup(self, s: A.Lookup, piped: DataFrame | None) -> DataFrame:
        if s.name in self.space.tags:
            tag = self.space.tag(s.name)
            scope, keys = self.tag_scope(tag, tag.live()), ["vid"]
        else:
            edge = self.space.edge(s.name)
            scope, keys = self.edge_scope(edge, edge.live()), ["src", "dst", "rank"]
        scope = self.matcher.filter(scope, s.where)
        return self.project(scope, s.result) if s.result else scope.df.select(*keys)

    def on_findpath(self, s: A.FindPath, piped: DataFrame | None) -> DataFrame:
        table = edge_table(self.space, s.types)
        if s.where is not None:
            props = {c: c for c in table.columns if c not in ("src", "dst", "rank", "type")}
            element = Element("edge", {"src": "src", "dst": "dst", "rank": "rank"}, props, s.types, "type")
            scope = Scope(table, {c: c for c in table.columns}, {"edge": element} | {k.name: element for k in edge_types(self.space, s.types)})
            table = self.matcher.filter(scope, s.where).df
        kind = table.schema["src"].dataType
        seen = directed(table, s.direction)
        sources, targets = self.source_ids(s.sources, piped, kind), self.source_ids(s.targets, piped, kind)
        if not s.shortest:
            out = paths.all_paths(seen, sources, targets, s.upto or 5, s.cycle, s.loop)
            out = out.withColumn("path", F.struct("nodes", "edges"))
        elif s.weight:
            weight = F.col("rank") if s.weight.lower() in ("ranking", "rank") else quoted(s.weight) if s.weight in table.columns else F.lit(None)
            out = paths.weighted_paths(seen, sources, targets, weight, s.upto).withColumn("path", F.struct("nodes"))
        else:
            out = paths.shortest_paths(seen, sources, targets, s.upto).withColumn("path", F.struct("nodes"))
        out = out.where("src != dst") if s.shortest else out
        if s.result:
            return self.project(plain(out), s.result)
        out = out.drop("path", *(["edges"] if "edges" in out.columns else []))
        if s.order:
            compile_ = self.compiler(plain(out))
            out = out.orderBy(*[compile_(e).asc_nulls_first() if up else compile_(e).desc_nulls_last() for e, up in s.order])
        return self.cut(out, s.skip, s.limit)

    def on_subgraph(self, s: A.Subgraph, piped: DataFrame | None) -> DataFrame:
        """Rows of kind vertex and edge; YIELD sees the columns kind, vid, distance, src, dst, rank and type."""
        table = edge_table(self.space, s.types, props=s.where is not None)
        if s.where is not None:
            element = Element("edge", {"src": "src", "dst": "dst", "rank": "rank"}, {c: c for c in table.columns}, s.types, "type")
            table = self.matcher.filter(Scope(table, {c: c for c in table.columns}, {"edge": element} | {k.name: element for k in edge_types(self.space, s.types)}), s.where).df
        table = table.select("src", "dst", "rank", "type")
        levels, kept = paths.subgraph(table, self.source_ids(s.sources, piped, table.schema["src"].dataType), s.steps, s.direction)
        vertices = levels.select(F.lit("vertex").alias("kind"), "vid", "distance")
        edges = kept.select(F.lit("edge").alias("kind"), "src", "dst", "rank", "type")
        out = vertices.unionByName(edges, allowMissingColumns=True)
        return self.project(plain(out), s.result) if s.result else out

    # -- search
    def on_search(self, s: A.Search, piped: DataFrame | None) -> DataFrame:
        index = self.space.indexes.get(s.index)
        if index is None or index.kind != "FULLTEXT":
            raise QueryError(f"no full-text index {s.index}")
        table = self.space.tag(index.on).live() if index.on in self.space.tags else self.space.edge(index.on).live()
        options = index.options
        weights = float(options.get("k1", 1.2)), float(options.get("b", 0.75))
        made = self.space.text_index(index)
        run = textindex.IndexSearcher(table, made, s.query, *weights) if made else search.Searcher(table, list(index.fields), s.query, *weights)
        df = run.run()
        scope = plain(df)
        column = lambda e: self.compiler(scope)(e)
        named = lambda e: F.lit(e.name) if isinstance(e, (A.Var, A.Prop)) else column(e)
        score = {
            "score": lambda: F.col("__score"),
            "highlight": lambda e, *rest: run.highlight(column(e), *[literal(column(x)) for x in rest]),
            "snippet": lambda e, n=None: run.snippet(column(e), literal(column(n)) if n is not None else 200),
            "matched_fields": lambda: F.col("__fields"),
            "field_score": lambda e=None: F.col("__score") if e is None else F.coalesce(F.element_at("__scores", named(e)), F.lit(0.0)),
            "search_match": lambda e=None: F.size("__fields") > 0 if e is None else F.array_contains("__fields", named(e)),
        }
        key = "vid" if "vid" in df.columns else "src"
        result = s.result or A.Projection([A.Item(A.Var(key), key, key), A.Item(A.Call("score", []), "score", "score()")])
        ranked = any(isinstance(x, A.Call) and x.name == "rank" and x.over is None for x in walk(result.items))
        if ranked:
            from pyspark.sql import Window

            score["rank"] = lambda: F.row_number().over(Window.orderBy(F.col("__score").desc(), F.col(key)))
        order = s.order
        if not order and s.limit is not None:
            order = [(A.Call("score", []), False), (A.Var(key), True)]
        result = replace(result, where=s.where if result.where is None else result.where, order=order, skip=s.offset, limit=s.limit)
        return self.project(replace(scope, values={c: c for c in df.columns if not c.startswith("__")}), result, score=score)

    def on_vectorsearch(self, s: A.VectorSearch, piped: DataFrame | None) -> DataFrame:
        index = self.space.indexes.get(s.index)
        if index is None or index.kind != "VECTOR":
            raise QueryError(f"no vector index {s.index}")
        tag = self.space.tag(index.on)
        metric = str(index.options.get("distance", "COSINE")).upper()
        scope = self.matcher.filter(self.tag_scope(tag, tag.live()), s.where)
        query = self.compiler(plain(self.one_row()))(s.query).cast("array<double>")
        df = search.vector_search(scope.df, index.fields[0], query, metric, s.threshold)
        df = df.orderBy(search.nearest_first(metric), "vid").limit(s.limit)
        if s.result:
            return self.project(plain(df), s.result, score={"score": lambda: F.col("score")})
        return df.drop(index.fields[0])

    # -- recursion
    def recursive(self, start: DataFrame, step: Any, most: int | None = None) -> DataFrame:
        """Rows of ``start`` and of ``step`` applied to the newest rows until none are new; more than ``most`` rounds are an error."""
        seen = settle(start.distinct(), "recursion")
        new = seen
        for n in paths.rounds(None):
            grown = step(new).toDF(*seen.columns).distinct()
            new = settle(relational.join(grown, seen, [(c, c) for c in seen.columns], "left_anti", null_safe=True), "recursion")
            if new.limit(1).count() == 0:
                return seen
            if n == most:
                raise QueryError(f"the recursion goes on after {most} rounds")
            seen = seen.union(new)
            if n % paths.LEVELS_A_TABLE == 0:
                seen = settle(seen, "recursion")

    # -- data changes as statements
    def __getattr__(self, name: str):
        if name in ("on_insertvertices", "on_insertedges", "on_update", "on_delete"):
            return getattr(Changes(self), name)
        raise AttributeError(name)


