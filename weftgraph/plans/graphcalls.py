"""Graph functions in query text: calls that look at the whole graph become joins on a vertex's key.

degree, neighbors, out_edges, in_edges, pagerank and connected_components take a vertex; shortest_path two; bfs a vertex and a
depth; variable_length_path two and the least and the greatest length. Of the edge types, those count whose ends are the vertex's
tag, where tags are known. Edges are taken as undirected but by out_edges, in_edges, pagerank and variable_length_path. Without
a vertex, pagerank() is a map of all scores and connected_components() a list of all components: one row that holds every vertex.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lang import ast as A
from weftgraph.lang.lexer import QueryError
from weftgraph.model import GraphSpace
from weftgraph.operators import algorithms, paths
from weftgraph.operators.traversal import directed, edge_table
from weftgraph.plans.expressions import Scope, quoted, walk
from weftgraph.runtime import settle

NAMES = frozenset(("degree", "neighbors", "out_edges", "in_edges", "pagerank", "connected_components", "shortest_path", "bfs", "variable_length_path"))
_fresh = count()


class GraphCalls:
    """Replaces the graph functions of some expressions by columns that it joins to a scope."""

    def __init__(self, space: GraphSpace, scope: Scope, compile_: Callable[[A.Expr], Column]):
        self.space, self.scope, self.compile_ = space, scope, compile_
        self.done: dict[str, str] = {}

    def edges(self, x: A.Expr | None) -> DataFrame:
        """(src, dst, rank, type) of the types that begin and end at the tag of a vertex, or of all."""
        element = self.scope.elements.get(x.name) if isinstance(x, A.Var) else None
        tags = set(element.names) if element and element.names else None
        fits = [e.name for e in self.space.edges.values() if tags is None or ({e.src_tag, e.dst_tag} <= tags | {None})]
        if not fits:
            raise QueryError("no edge type joins vertices of this tag")
        return edge_table(self.space, fits, props=False)

    def key(self, x: A.Expr) -> Column:
        element = self.scope.elements.get(x.name) if isinstance(x, A.Var) else None
        return quoted(element.keys["vid"]) if element else self.compile_(x)

    def join(self, args: list[A.Expr], values: Callable[[DataFrame], DataFrame], empty: Column | None, name: str) -> None:
        """Join (k0, k1, …, value) of the distinct arguments; ``empty`` stands where there is none."""
        keys = [f"{name}_k{i}" for i in range(len(args))]
        df = self.scope.df.withColumns(dict(zip(keys, map(self.key, args), strict=True)))
        found = values(df.select(*keys).distinct().toDF(*[f"k{i}" for i in range(len(args))]))
        found = found.select(*[F.col(f"k{i}").alias(f"{k}_") for i, k in enumerate(keys)], F.col("value").alias(name))
        on = [F.col(k) == F.col(f"{k}_") for k in keys]
        df = df.join(found, on, "left").drop(*keys, *[f"{k}_" for k in keys])
        if empty is not None:
            df = df.withColumn(name, F.coalesce(F.col(name), empty.cast(df.schema[name].dataType)))
        self.scope = replace(self.scope, df=df, values=self.scope.values | {name: name})

    def call(self, c: A.Call) -> A.Expr:
        if (known := self.done.get(repr(c))) is not None:
            return A.Var(known)
        name = f"_g{next(_fresh)}"
        first = c.args[0] if c.args else None
        table = self.edges(first)
        wants = {"shortest_path": (2,), "bfs": (2,), "variable_length_path": (3, 4), "pagerank": (0, 1), "connected_components": (0, 1)}.get(c.name, (1,))
        if len(c.args) not in wants:
            raise QueryError(f"{c.name} takes {' or '.join(map(str, wants))} arguments")
        if not c.args:
            self.whole(c.name, table, name)
        elif c.name in ("degree", "neighbors"):
            near = directed(table, "both").select(F.col("here").alias("k0"), "there")
            value = F.count("*") if c.name == "degree" else F.sort_array(F.collect_list("there"))
            self.join(c.args, lambda ids: near.join(ids, "k0", "left_semi").groupBy("k0").agg(value.alias("value")), F.lit(0) if c.name == "degree" else F.array(), name)
        elif c.name in ("out_edges", "in_edges"):
            end = "src" if c.name == "out_edges" else "dst"
            value = F.sort_array(F.collect_list(F.struct("src", "dst", "rank", "type"))).alias("value")
            self.join(c.args, lambda ids: table.withColumn("k0", F.col(end)).join(ids, "k0", "left_semi").groupBy("k0").agg(value), F.array(), name)
        elif c.name in ("pagerank", "connected_components"):
            self.join(c.args, lambda ids: self.vertex_values(c.name, table).toDF("k0", "value"), None, name)
        elif c.name == "shortest_path":
            self.join(c.args, lambda ids: self.lengths(table, ids), F.lit(-1), name)
        elif c.name == "bfs":
            depth = self.number(c.args[1])
            both = directed(table, "both")
            reached = lambda ids: paths.bfs_levels(both, ids, depth).groupBy(F.col("source").alias("k0")).agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "vid"))), lambda x: x["vid"]).alias("value"))
            self.join(c.args[:1], reached, None, name)
        else:
            low, high = ([1, self.number(c.args[2])] if len(c.args) == 3 else [self.number(x) for x in c.args[2:]])
            self.join(c.args[:2], lambda ids: self.walks(table, ids, low, high), F.array(), name)
        self.done[repr(c)] = name
        return A.Var(name)

    @staticmethod
    def number(x: A.Expr) -> int:
        value = getattr(x, "value", None)
        if not isinstance(value, int):
            raise QueryError("a depth has to be a whole number")
        return value

    def vertex_values(self, name: str, table: DataFrame) -> DataFrame:
        return algorithms.pagerank(table) if name == "pagerank" else algorithms.connected_components(table)

    def whole(self, name: str, table: DataFrame, column: str) -> None:
        """The value of the whole graph: one row, so a cross join with it adds none."""
        if name == "pagerank":
            one = algorithms.pagerank(table).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("vid", "score")))).alias(column))
        else:
            lists = algorithms.connected_components(table).groupBy("component").agg(F.sort_array(F.collect_list("vid")).alias("vids"))
            one = lists.agg(F.sort_array(F.collect_list("vids")).alias(column))
        self.scope = replace(self.scope, df=self.scope.df.crossJoin(one), values=self.scope.values | {column: column})

    @staticmethod
    def lengths(table: DataFrame, ids: DataFrame) -> DataFrame:
        ids = settle(ids, "pairs")
        found = paths.shortest_paths(directed(table, "both"), ids.select("k0"), ids.select("k1"))
        found = found.select(F.col("src").alias("k0"), F.col("dst").alias("k1"), F.col("length").alias("value"))
        return found.join(ids, ["k0", "k1"], "left_semi")

    @staticmethod
    def walks(table: DataFrame, ids: DataFrame, low: int, high: int) -> DataFrame:
        ids = settle(ids, "pairs")
        found = paths.all_paths(directed(table, "out"), ids.select("k0"), ids.select("k1"), high).where(F.col("length") >= low)
        found = found.groupBy(F.col("src").alias("k0"), F.col("dst").alias("k1")).agg(F.sort_array(F.collect_list("nodes")).alias("value"))
        return found.join(ids, ["k0", "k1"], "left_semi")


def has_calls(x: object) -> bool:
    return any(isinstance(e, A.Call) and e.name in NAMES and e.over is None for e in walk(x))
