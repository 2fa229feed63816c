"""INSERT, CREATE, UPDATE, UPSERT, DELETE, MERGE, SET and REMOVE as table transforms on the space."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.model import EdgeType, Tag
from weftgraph.operators import changes
from weftgraph.plans.expressions import Compiler, Scope, plain, quoted


class Changes:
    def __init__(self, translator: Any):
        self.t, self.space = translator, translator.space

    def done(self, n: int | None = None) -> DataFrame:
        return self.space.spark.range(1).select(F.lit("ok").alias("status"), F.lit(n).cast("long").alias("count"))

    def rows(self, table: DataFrame, columns: list[str], rows: list[list[A.Expr]]) -> DataFrame:
        """Constant rows in the types of ``table``'s columns."""
        one = self.t.one_row()
        compile_ = self.t.compiler(plain(one))
        kinds = {f.name: f.dataType for f in table.schema}
        for c in columns:
            if c not in kinds:
                raise QueryError(f"no property {c}")
        made = [F.struct(*[compile_(v).cast(kinds[c]).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]
        return one.select(F.inline(F.array(*made)))

    def defaulted(self, rows: DataFrame, schema: Any, columns: list[str]) -> DataFrame:
        for c, v in schema.defaults.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(v))
        missing = [c for c in schema.required if c not in rows.columns]
        if missing:
            raise QueryError(f"{missing[0]} may not be NULL")
        return rows

    # -- INSERT
    def on_insertvertices(self, s: A.InsertVertices, piped: DataFrame | None = None) -> DataFrame:
        for n, (name, props) in enumerate(s.tags):
            tag = self.space.tag(name)
            rows = [[vid, *values[n]] for vid, values in s.rows]
            columns = ["vid", *(props or tag.props[: len(s.rows[0][1][n])])]
            new = self.defaulted(self.rows(tag.df, columns, rows), tag.schema, columns)
            self.space.swap_tag(name, changes.insert(tag.df, new, ["vid"], s.if_not_exists))
        return self.done(len(s.rows))

    def on_insertedges(self, s: A.InsertEdges, piped: DataFrame | None = None) -> DataFrame:
        edge = self.space.edge(s.type)
        rows = [[src, dst, rank if rank is not None else A.Lit(0), *values] for src, dst, rank, values in s.rows]
        columns = ["src", "dst", "rank", *(s.props or edge.props[: len(s.rows[0][3])])]
        new = self.defaulted(self.rows(edge.df, columns, rows), edge.schema, columns)
        self.space.swap_edge(s.type, changes.insert(edge.df, new, ["src", "dst", "rank"], s.if_not_exists))
        return self.done(len(s.rows))

    # -- UPDATE and UPSERT
    def on_update(self, s: A.Update, piped: DataFrame | None = None) -> DataFrame:
        key = [self.t.constant(k) if k is not None else 0 for k in s.key]
        if s.kind == "VERTEX":
            names = [s.name] if s.name else [n for n, t in self.space.tags.items() if all(c in t.props for c, _ in s.sets)]
            if not names:
                raise QueryError("no tag has these properties")
            owner: Tag | EdgeType = self.space.tag(names[0])
            test, keys = F.col("vid") == key[0], ["vid"]
        else:
            owner, keys = self.space.edge(s.name), ["src", "dst", "rank"]
            test = (F.col("src") == key[0]) & (F.col("dst") == key[1]) & (F.col("rank") == key[2])
        scope = self.t.tag_scope(owner, owner.df) if s.kind == "VERTEX" else self.t.edge_scope(owner, owner.df)
        compile_ = self.t.compiler(scope)
        where = test & compile_(s.where) if s.where is not None else test
        new = changes.update(owner.df, where, {c: compile_(v) for c, v in s.sets})
        if s.insert:
            fixed = [(c, v) for c, v in s.sets if not any(isinstance(x, A.Var) for x in [v])]
            row = self.rows(owner.df, [*keys, *[c for c, _ in fixed]], [[*map(A.Lit, key), *[v for _, v in fixed]]])
            row = self.defaulted(row, replace(owner.schema, required=()), keys)
            new = new.unionByName(changes.align(row.join(owner.df.select(*keys), keys, "left_anti"), owner.df))
        (self.space.swap_tag if s.kind == "VERTEX" else self.space.swap_edge)(owner.name, new)
        if s.result:
            after = (self.t.tag_scope if s.kind == "VERTEX" else self.t.edge_scope)(owner, new.where(test))
            if s.kind == "EDGE":
                after = replace(after, elements=after.elements | {"$^": after.elements["edge"]})
            return self.t.project(after, s.result)
        return self.done()

    # -- DELETE
    def drop_vertices(self, ids: DataFrame, with_edge: bool, tags: list[str] | None = None) -> None:
        for name in tags or list(self.space.tags):
            tag = self.space.tag(name)
            self.space.swap_tag(name, changes.delete(tag.df, ids, [("vid", ids.columns[0])]))
        if with_edge:
            for name, e in self.space.edges.items():
                left = changes.delete(e.df, ids, [("src", ids.columns[0])])
                self.space.swap_edge(name, changes.delete(left, ids, [("dst", ids.columns[0])]))

    def on_delete(self, s: A.Delete, piped: DataFrame | None = None) -> DataFrame:
        if s.kind in ("VERTEX", "TAG"):
            ids = self.t.source_ids(s.ids, piped, self.space.vid_type).withColumnRenamed("vid", "__id")
            self.drop_vertices(ids, s.with_edge, None if s.kind == "VERTEX" or s.names == ["*"] else s.names)
            return self.done()
        edge = self.space.edge(s.names[0])
        if piped is not None:
            compile_ = self.t.compiler(plain(piped, piped=True))
            src, dst, rank = s.edges[0]
            keys = piped.select(compile_(src).alias("s"), compile_(dst).alias("d"), (compile_(rank) if rank is not None else F.lit(0)).cast("long").alias("r"))
        else:
            rows = [[a, b, r if r is not None else A.Lit(0)] for a, b, r in s.edges]
            keys = self.rows(edge.df, ["src", "dst", "rank"], rows).toDF("s", "d", "r")
        self.space.swap_edge(edge.name, changes.delete(edge.df, keys, [("src", "s"), ("dst", "d"), ("rank", "r")]))
        return self.done()

    # -- clauses after MATCH
    def clause(self, scope: Scope | None, c: Any, later: list[Any]) -> DataFrame:
        if isinstance(c, A.CreatePattern):
            return self.create(scope, c)
        if isinstance(c, A.Merge):
            return self.merge(c)
        if scope is None:
            raise QueryError("there is nothing matched to change")
        if isinstance(c, A.SetMatched):
            return self.assign(scope, c.sets)
        if isinstance(c, A.RemoveMatched):
            if c.props:
                self.assign(scope, [(v, p, A.Lit(None)) for v, p in c.props])
            for var, label in c.labels:
                ids = scope.df.select(quoted(scope.elements[var].keys["vid"]).alias("__id")).distinct()
                self.drop_vertices(ids, False, [label])
            return self.done()
        for var in c.vars:
            e = scope.elements[var]
            if e.kind == "node":
                ids = scope.df.select(quoted(e.keys["vid"]).alias("__id")).distinct()
                self.drop_vertices(ids, c.detach, e.names or None)
            else:
                keys = scope.df.select(*[quoted(e.keys[k]).alias(n) for k, n in (("src", "s"), ("dst", "d"), ("rank", "r"))]).distinct()
                for name in e.names:
                    edge = self.space.edge(name)
                    self.space.swap_edge(name, changes.delete(edge.df, keys, [("src", "s"), ("dst", "d"), ("rank", "r")]))
        return self.done()

    def assign(self, scope: Scope, sets: list[tuple[str, str, A.Expr]]) -> DataFrame:
        """New values by key, joined onto the table; a key matched more than once takes its largest value."""
        compile_ = self.t.compiler(scope)
        by_var: dict[str, dict[str, Column]] = {}
        for var, prop, value in sets:
            by_var.setdefault(var, {})[prop] = compile_(value)
        for var, new in by_var.items():
            e = scope.elements[var]
            keys = list(e.keys)
            side = scope.df.groupBy(*[quoted(c).alias(f"__{k}") for k, c in e.keys.items()]).agg(*[F.max(F.struct(v.alias("v"))).alias(f"__new_{p}") for p, v in new.items()]).withColumn("__hit", F.lit(True))
            for name in e.names[:1]:
                owner = self.space.tag(name) if e.kind == "node" else self.space.edge(name)
                on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
                joined = owner.df.join(side, on, "left")
                kinds = {f.name: f.dataType for f in owner.df.schema}
                values = {}
                for p in new:
                    fresh = F.when(F.col("__hit"), F.col(f"__new_{p}")["v"])
                    values[p] = F.when(F.col("__hit"), F.col(f"__new_{p}")["v"].cast(kinds[p])).otherwise(F.col(p)) if p in kinds else fresh
                columns = [*owner.df.columns, *[p for p in new if p not in kinds]]
                df = joined.withColumns(values).select(*columns)
                (self.space.swap_tag if e.kind == "node" else self.space.swap_edge)(name, df)
        return self.done()

    # -- CREATE and MERGE patterns
    def infer(self, props: list[tuple[str, A.Expr]]) -> list[StructField]:
        one = self.t.one_row()
        compile_ = self.t.compiler(plain(one))
        out = []
        for k, v in props:
            value = v.value if isinstance(v, A.Lit) else None
            kind = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType()}.get(type(value))
            out.append(StructField(k, kind or one.select(compile_(v).alias(k)).schema[0].dataType))
        return out

    def ensure_tag(self, name: str, props: list[tuple[str, A.Expr]]) -> Tag:
        if name not in self.space.tags:
            self.space.tags[name] = Tag(name, self.space.empty_tag(self.infer(props)))
        tag = self.space.tag(name)
        missing = [(k, v) for k, v in props if k not in tag.props]
        if missing:
            self.space.swap_tag(name, tag.df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.infer(missing)]))
        return self.space.tag(name)

    def new_id(self) -> A.Lit:
        return A.Lit(uuid.uuid4().hex if isinstance(self.space.vid_type, StringType) else uuid.uuid4().int >> 65)

    def create_node(self, x: A.NodePattern) -> A.Lit:
        given = dict(x.props)
        vid = given.get("_vid") or given.get("vid") or given.get("id")
        vid = A.Lit(self.t.constant(vid)) if vid is not None else self.new_id()
        for label in x.labels:
            props = [(k, v) for k, v in x.props if k not in ("_vid", "vid")]
            tag = self.ensure_tag(label, props)
            rows = self.rows(tag.df, ["vid", *[k for k, _ in props]], [[vid, *[v for _, v in props]]])
            self.space.swap_tag(label, changes.insert(tag.df, self.defaulted(rows, tag.schema, []), ["vid"]))
        return vid

    def create(self, scope: Scope | None, c: A.CreatePattern) -> DataFrame:
        made: dict[str, A.Lit] = {}
        count = 0
        for p in c.patterns:
            ends: list[Any] = []
            for x in p.elements[::2]:
                if x.var and scope is not None and x.var in scope.elements:
                    ends.append(("column", x.var))
                elif x.var and x.var in made:
                    ends.append(made[x.var])
                else:
                    vid = self.create_node(x)
                    count += 1
                    if x.var:
                        made[x.var] = vid
                    ends.append(vid)
            for e, a, b in zip(p.elements[1::2], ends, ends[1:], strict=False):
                if e.direction == "in":
                    a, b = b, a
                self.create_edge(scope, e, a, b)
                count += 1
        return self.done(count)

    def create_edge(self, scope: Scope | None, e: A.EdgePattern, a: Any, b: Any) -> None:
        name = e.types[0]
        if name not in self.space.edges:
            self.space.edges[name] = EdgeType(name, self.space.empty_edge(self.infer(e.props)))
        edge = self.space.edge(name)
        missing = [(k, v) for k, v in e.props if k not in edge.props]
        if missing:
            self.space.swap_edge(name, edge.df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.infer(missing)]))
            edge = self.space.edge(name)
        matched = scope is not None and (isinstance(a, tuple) or isinstance(b, tuple))
        base = scope if matched else plain(self.t.one_row())
        compile_ = Compiler(base, self.t.params)
        end = lambda x: quoted(scope.elements[x[1]].keys["vid"]) if isinstance(x, tuple) else compile_(x)
        rows = base.df.select(end(a).alias("src"), end(b).alias("dst"), F.lit(0).cast("long").alias("rank"), *[compile_(v).alias(k) for k, v in e.props]).distinct()
        self.space.swap_edge(name, changes.insert(edge.df, changes.align(rows, edge.df), ["src", "dst", "rank"]))

    def merge(self, c: A.Merge) -> DataFrame:
        """Match the pattern; if there is none create it, then apply ON CREATE, else ON MATCH."""
        p = replace(c.pattern, elements=[replace(x, var=x.var or f"_m{i}") for i, x in enumerate(c.pattern.elements)])
        for x in p.elements[::2]:
            for label in x.labels:
                self.ensure_tag(label, x.props)
        for e in p.elements[1::2]:
            if e.types[0] not in self.space.edges:
                self.space.edges[e.types[0]] = EdgeType(e.types[0], self.space.empty_edge(self.infer(e.props)))
        for var, prop, value in (*c.on_match, *c.on_create):
            for x in p.elements:
                if x.var == var and isinstance(x, A.NodePattern):
                    self.ensure_tag(x.labels[0], [(prop, value)] if not any(isinstance(v, A.Prop) for v in [value]) else [])
        found = self.t.matcher.paths(None, [p])
        if found.df.limit(1).count():
            return self.assign(found, c.on_match) if c.on_match else self.done(0)
        if len(p.elements) == 1:
            self.create(None, A.CreatePattern([p]))
        else:  # ends that exist are kept, the others made
            scope = None
            for x in p.elements[::2]:
                own = self.t.matcher.paths(None, [A.PathPattern([x])])
                if not own.df.limit(1).count():
                    self.create_node(x)
                scope = self.t.matcher.paths(scope, [A.PathPattern([x])])
            self.create(scope, A.CreatePattern([p]))
        if c.on_create:
            self.assign(self.t.matcher.paths(None, [p]), c.on_create)
        return self.done(1)
