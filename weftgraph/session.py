"""Sessions: spaces, schema statements, transactions, variables and plan inspection."""

from __future__ import annotations

import time
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.lang.parser import parse
from weftgraph.model import EdgeType, GraphSpace, Index, Schema, Tag, spark_type
from weftgraph.plans.translate import Translator


class Session:
    """Runs query text against the space in use."""

    def __init__(self, space: GraphSpace | None = None, spark: SparkSession | None = None):
        self.space = space
        self.spark = space.spark if space is not None else spark
        self.spaces: dict[str, GraphSpace] = {space.name: space} if space is not None else {}
        self.variables: dict[str, DataFrame] = {}

    def query(self, text: str, **params: Any) -> DataFrame:
        out: DataFrame | None = None
        for statement in parse(text):
            out = self.run(statement, params)
        if out is None:
            raise QueryError("empty text")
        return out

    def translator(self, params: dict[str, Any]) -> Translator:
        if self.space is None:
            raise QueryError("no space in use")
        return Translator(self.space, params, self.variables)

    def run(self, s: Any, params: dict[str, Any]) -> DataFrame:
        if isinstance(s, A.Explain):
            return self.explain(s, params)
        if isinstance(s, A.Assign):
            self.variables[s.name] = self.translator(params).query(s.query)
            return self.variables[s.name]
        only = s.first[0] if isinstance(s, A.Query) and len(s.first) == 1 and not s.rest else None
        if isinstance(only, A.Admin):
            handler = getattr(self, f"{only.verb}_{only.what}".lower().replace(" ", "_"), None)
            if handler is None:
                raise QueryError(f"{only.verb} {only.what} isn't supported")
            return handler(only)
        return self.translator(params).query(s)

    # -- results of schema statements
    def rows(self, rows: list[tuple], *columns: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], StructType([StructField(c, StringType()) for c in columns]))

    def ok(self) -> DataFrame:
        return self.rows([("ok",)], "status")

    # -- plans
    def explain(self, s: A.Explain, params: dict[str, Any]) -> DataFrame:
        df = self.run(s.query, params)
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        if s.profile:
            began = time.perf_counter()
            n = df.count()
            return self.rows([(n, f"{time.perf_counter() - began:.3f}", text)], "rows", "seconds", "plan")
        if s.format == "DOT":
            text = dot(text)
        return self.rows([(text,)], "plan")

    # -- spaces
    def create_space(self, s: A.Admin) -> DataFrame:
        if s.name in self.spaces:
            if s.args["if_not_exists"]:
                return self.ok()
            raise QueryError(f"space {s.name} exists")
        options = s.args["options"]
        kind = StringType() if "STRING" in str(options.get("vid_type", "INT64")).upper() else None
        self.spaces[s.name] = GraphSpace(self.spark, s.name, kind, options)
        return self.ok()

    def drop_space(self, s: A.Admin) -> DataFrame:
        if self.spaces.pop(s.name, None) is None and not s.args["if_exists"]:
            raise QueryError(f"no space {s.name}")
        if self.space is not None and self.space.name == s.name:
            self.space = None
        return self.ok()

    def use_space(self, s: A.Admin) -> DataFrame:
        if s.name not in self.spaces:
            raise QueryError(f"no space {s.name}")
        self.space = self.spaces[s.name]
        return self.ok()

    def clear_space(self, s: A.Admin) -> DataFrame:
        space = self.spaces[s.name]
        for n, t in space.tags.items():
            space.swap_tag(n, t.df.limit(0))
        for n, e in space.edges.items():
            space.swap_edge(n, e.df.limit(0))
        return self.ok()

    def show_spaces(self, s: A.Admin) -> DataFrame:
        return self.rows([(n,) for n in sorted(self.spaces)], "name")

    def desc_space(self, s: A.Admin) -> DataFrame:
        x = self.spaces[s.name]
        return self.rows([(x.name, x.vid_type.simpleString(), len(x.tags), len(x.edges))], "name", "vid_type", "tags", "edges")

    def alter_space(self, s: A.Admin) -> DataFrame:
        self.spaces[s.name].options |= s.args["options"]
        return self.ok()

    # -- tags and edge types
    def declared(self, s: A.Admin) -> tuple[list[StructField], Schema]:
        fields, defaults, required, comments = [], {}, [], {}
        for f in s.args["fields"]:
            fields.append(StructField(f["name"], _parse_datatype_string(spark_type(f["type"]))))
            if "default" in f:
                defaults[f["name"]] = self.translator({}).constant(f["default"])
            elif not f["nullable"]:
                required.append(f["name"])
            if "comment" in f:
                comments[f["name"]] = f["comment"]
        ttl = s.args["ttl"]
        return fields, Schema(defaults, tuple(required), comments, ttl.get("ttl_col"), ttl.get("ttl_duration"))

    def create_tag(self, s: A.Admin) -> DataFrame:
        if s.name in self.space.tags:
            if s.args["if_not_exists"]:
                return self.ok()
            raise QueryError(f"tag {s.name} exists")
        fields, schema = self.declared(s)
        self.space.tags[s.name] = Tag(s.name, self.space.empty_tag(fields), schema)
        return self.ok()

    def create_edge(self, s: A.Admin) -> DataFrame:
        if s.name in self.space.edges:
            if s.args["if_not_exists"]:
                return self.ok()
            raise QueryError(f"edge type {s.name} exists")
        fields, schema = self.declared(s)
        self.space.edges[s.name] = EdgeType(s.name, self.space.empty_edge(fields), s.args.get("src_tag"), s.args.get("dst_tag"), schema)
        return self.ok()

    def altered(self, df: DataFrame, schema: Schema, args: dict[str, Any]) -> tuple[DataFrame, Schema]:
        defaults, comments = dict(schema.defaults), dict(schema.comments)
        for f in args["add"]:
            value = self.translator({}).constant(f["default"]) if "default" in f else None
            df = df.withColumn(f["name"], F.lit(value).cast(spark_type(f["type"])))
            if value is not None:
                defaults[f["name"]] = value
        df = df.drop(*args["drop"])
        for old, f in args["change"]:
            df = df.withColumn(old, F.col(old).try_cast(spark_type(f["type"]))).withColumnRenamed(old, f["name"])
        gone = set(args["drop"]) | {old for old, _ in args["change"]}
        return df, replace(schema, defaults={k: v for k, v in defaults.items() if k not in gone}, required=tuple(c for c in schema.required if c not in gone), comments={k: v for k, v in comments.items() if k not in gone})

    def alter_tag(self, s: A.Admin) -> DataFrame:
        tag = self.space.tag(s.name)
        df, schema = self.altered(tag.df, tag.schema, s.args)
        self.space.tags[s.name] = replace(tag, df=df, schema=schema)
        return self.ok()

    def alter_edge(self, s: A.Admin) -> DataFrame:
        edge = self.space.edge(s.name)
        df, schema = self.altered(edge.df, edge.schema, s.args)
        self.space.edges[s.name] = replace(edge, df=df, schema=schema)
        return self.ok()

    def dropped(self, s: A.Admin, table: dict[str, Any], what: str) -> DataFrame:
        for n in s.args["names"]:
            if table.pop(n, None) is None and not s.args["if_exists"]:
                raise QueryError(f"no {what} {n}")
        return self.ok()

    def drop_tag(self, s: A.Admin) -> DataFrame:
        return self.dropped(s, self.space.tags, "tag")

    def drop_edge(self, s: A.Admin) -> DataFrame:
        return self.dropped(s, self.space.edges, "edge type")

    def drop_index(self, s: A.Admin) -> DataFrame:
        return self.dropped(s, self.space.indexes, "index")

    drop_fulltext = drop_vector = drop_index

    def described(self, df: DataFrame, schema: Schema, keys: tuple[str, ...]) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), "NO" if f.name in schema.required else "YES", schema.defaults.get(f.name), schema.comments.get(f.name)) for f in df.schema if f.name not in keys]
        return self.rows(rows, "field", "type", "nullable", "default", "comment")

    def desc_tag(self, s: A.Admin) -> DataFrame:
        t = self.space.tag(s.name)
        return self.described(t.df, t.schema, ("vid",))

    def desc_edge(self, s: A.Admin) -> DataFrame:
        e = self.space.edge(s.name)
        return self.described(e.df, e.schema, ("src", "dst", "rank"))

    def show_tags(self, s: A.Admin) -> DataFrame:
        return self.rows([(n,) for n in sorted(self.space.tags)], "name")

    def show_edges(self, s: A.Admin) -> DataFrame:
        return self.rows([(n,) for n in sorted(self.space.edges)], "name")

    def declaration(self, what: str, name: str, df: DataFrame, schema: Schema, keys: tuple[str, ...]) -> DataFrame:
        fields = []
        for f in df.schema:
            if f.name not in keys:
                text = f"{f.name}: {f.dataType.simpleString().upper()}" + " NOT NULL" * (f.name in schema.required)
                text += f" DEFAULT {schema.defaults[f.name]!r}" if f.name in schema.defaults else ""
                fields.append(text)
        if schema.ttl_column:
            fields += [f"ttl_duration={schema.ttl_seconds}", f"ttl_col={schema.ttl_column}"]
        return self.rows([(name, f"CREATE {what} {name}({', '.join(fields)})")], "name", "statement")

    def show_create_tag(self, s: A.Admin) -> DataFrame:
        t = self.space.tag(s.name)
        return self.declaration("TAG", s.name, t.df, t.schema, ("vid",))

    def show_create_edge(self, s: A.Admin) -> DataFrame:
        e = self.space.edge(s.name)
        return self.declaration("EDGE", s.name, e.df, e.schema, ("src", "dst", "rank"))

    # -- indexes are metadata, as filters reach the files' own statistics; a full-text index is a table of postings too
    def indexed(self, s: A.Admin, kind: str) -> DataFrame:
        if s.name in self.space.indexes:
            if s.args["if_not_exists"]:
                return self.ok()
            raise QueryError(f"index {s.name} exists")
        on = s.args["on"]
        owner = self.space.tags.get(on) or self.space.edge(on)
        missing = [f for f in s.args["fields"] if f not in owner.df.columns]
        if missing:
            raise QueryError(f"{on} has no property {missing[0]}")
        self.space.indexes[s.name] = Index(s.name, kind, on, tuple(s.args["fields"]), s.args["options"])
        return self.ok()

    def create_index(self, s: A.Admin) -> DataFrame:
        return self.indexed(s, "INDEX")

    def create_fulltext(self, s: A.Admin) -> DataFrame:
        new = s.name not in self.space.indexes
        out = self.indexed(s, "FULLTEXT")
        if new:
            self.space.build_text_index(s.name)
        return out

    def create_vector(self, s: A.Admin) -> DataFrame:
        return self.indexed(s, "VECTOR")

    def alter_fulltext(self, s: A.Admin) -> DataFrame:
        index = self.space.indexes[s.name]
        self.space.indexes[s.name] = replace(index, options=index.options | s.args["options"])
        return self.ok()

    def rebuild_index(self, s: A.Admin) -> DataFrame:
        if s.name not in self.space.indexes:
            raise QueryError(f"no index {s.name}")
        if self.space.indexes[s.name].kind == "FULLTEXT":
            self.space.build_text_index(s.name)
        return self.ok()

    def listed(self, kinds: tuple[str, ...]) -> DataFrame:
        found = sorted((i for i in self.space.indexes.values() if i.kind in kinds), key=lambda i: i.name)
        return self.rows([(i.name, i.kind, i.on, ",".join(i.fields)) for i in found], "name", "kind", "on", "fields")

    def show_indexes(self, s: A.Admin) -> DataFrame:
        return self.listed(("INDEX",))

    def show_fulltext_indexes(self, s: A.Admin) -> DataFrame:
        return self.listed(("FULLTEXT",))

    def show_vector_indexes(self, s: A.Admin) -> DataFrame:
        return self.listed(("VECTOR",))

    def desc_index(self, s: A.Admin) -> DataFrame:
        i = self.space.indexes[s.name]
        return self.rows([(i.name, i.kind, i.on, ",".join(i.fields), i.options)], "name", "kind", "on", "fields", "options")

    desc_fulltext = desc_index

    # -- statistics and configuration
    def show_stats(self, s: A.Admin) -> DataFrame:
        parts = [t.df.select(F.lit("tag").alias("kind"), F.lit(n).alias("name")) for n, t in self.space.tags.items()]
        parts += [e.df.select(F.lit("edge").alias("kind"), F.lit(n).alias("name")) for n, e in self.space.edges.items()]
        counted = [p.groupBy("kind", "name").count() for p in parts]
        out = counted[0]
        for c in counted[1:]:
            out = out.union(c)
        return out

    analyze_stats = show_stats

    def show_configs(self, s: A.Admin) -> DataFrame:
        return self.rows(sorted((k, v) for k, v in self.spark.conf.getAll.items() if k.startswith("spark.sql")), "name", "value")

    def set_config(self, s: A.Admin) -> DataFrame:
        self.spark.conf.set(s.name, str(self.translator({}).constant(s.args["value"])))
        return self.ok()

    # -- transactions
    def begin_transaction(self, s: A.Admin) -> DataFrame:
        self.space.begin()
        return self.ok()

    def commit_transaction(self, s: A.Admin) -> DataFrame:
        self.space.commit()
        return self.ok()

    def rollback_transaction(self, s: A.Admin) -> DataFrame:
        self.space.rollback()
        return self.ok()

    def savepoint_savepoint(self, s: A.Admin) -> DataFrame:
        self.space.begin(s.name)
        return self.ok()

    def rollback_savepoint(self, s: A.Admin) -> DataFrame:
        self.space.rollback(s.name)
        return self.ok()


def dot(plan: str) -> str:
    """The operator tree of a formatted plan as a DOT graph."""
    nodes, links, stack = [], [], []
    for line in plan.split("\n\n")[0].splitlines():
        body = line.lstrip(" :+-*")
        if "(" not in body or line.startswith("=="):
            continue
        depth = len(line) - len(body)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        n = len(nodes)
        nodes.append(f'  n{n} [label="{body.strip()}"];')
        if stack:
            links.append(f"  n{stack[-1][1]} -> n{n};")
        stack.append((depth, n))
    return "digraph plan {\n" + "\n".join(nodes + links) + "\n}"
