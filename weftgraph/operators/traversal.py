"""Expansion along edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.model import EdgeType, GraphSpace

KEYS = ("src", "dst", "rank")


def directed(df: DataFrame, direction: str) -> DataFrame:
    """Edges seen from where a traversal stands: ``here`` and ``there`` beside the edge's own ends.

    In both directions a self-loop is seen once.
    """
    out = df.withColumns({"here": F.col("src"), "there": F.col("dst")})
    back = df.withColumns({"here": F.col("dst"), "there": F.col("src")})
    if direction == "out":
        return out
    if direction == "in":
        return back
    return out.unionByName(back.where(F.col("src") != F.col("dst")))


def edge_types(space: GraphSpace, names: list[str]) -> list[EdgeType]:
    return list(space.edges.values()) if not names or names == ["*"] else [space.edge(n) for n in names]


def edge_table(space: GraphSpace, names: list[str], props: bool = True) -> DataFrame:
    """The edges of several types as one table with their type's name; properties that a type lacks are NULL."""
    kinds = edge_types(space, names)
    if not kinds:
        raise ValueError("the space has no edge types")
    same = {(e.df.schema["src"].dataType.simpleString(), e.df.schema["dst"].dataType.simpleString()) for e in kinds}
    uniform = len({t for pair in same for t in pair}) == 1

    def one(e: EdgeType) -> DataFrame:
        key = lambda c: F.col(c) if uniform else F.col(c).cast("string")
        kept = [F.col(c) for c in e.props] if props else []
        return e.live().select(key("src").alias("src"), key("dst").alias("dst"), "rank", F.lit(e.name).alias("type"), *kept)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, kinds))


def neighbors(space: GraphSpace, ids: DataFrame, types: list[str], direction: str = "out") -> DataFrame:
    """(vid, neighbor, type, rank) of the vertices in the column ``vid``."""
    edges = directed(edge_table(space, types, props=False), direction)
    return ids.select("vid").join(edges, F.col("vid") == F.col("here")).select("vid", F.col("there").alias("neighbor"), "type", "rank")


def expand(edges: DataFrame, frontier: DataFrame, low: int, high: int) -> DataFrame:
    """(origin-free) the last edges of all walks of low to high steps from the vids of ``frontier``.

    ``edges`` is :func:`directed`. Frontiers are made distinct before each step, so a walk's length and not the number of
    walks bounds the work.
    """
    at = frontier.select(F.col(frontier.columns[0]).alias("at")).distinct()
    out = []
    for step in range(1, high + 1):
        hop = at.join(edges, F.col("at") == F.col("here"), "inner").drop("at")
        if step >= low:
            out.append(hop.withColumn("step", F.lit(step)))
        if step < high:
            at = hop.select(F.col("there").alias("at")).distinct()
    if low == 0:
        raise ValueError("a walk of no steps has no edge")
    return reduce(DataFrame.unionByName, out)


def expand_sampled(edges: DataFrame, frontier: DataFrame, steps: int, fanout: int, seed: int = 7) -> DataFrame:
    """Like :func:`expand` with at most ``fanout`` edges a vertex and step, those of least hash."""
    from pyspark.sql import Window

    at = frontier.select(F.col(frontier.columns[0]).alias("at")).distinct()
    out = []
    for step in range(1, steps + 1):
        hop = at.join(edges, F.col("at") == F.col("here")).drop("at")
        pick = Window.partitionBy("here").orderBy(F.xxhash64(F.lit(seed + step), "src", "dst", "rank"), "src", "dst", "rank")
        hop = hop.withColumn("__n", F.row_number().over(pick)).where(F.col("__n") <= fanout).drop("__n")
        out.append(hop.withColumn("step", F.lit(step)))
        at = hop.select(F.col("there").alias("at")).distinct()
    return reduce(DataFrame.unionByName, out)


def degrees(space: GraphSpace, types: list[str]) -> DataFrame:
    """(vid, out_degree, in_degree, degree), both directions in one pass over the edges."""
    edges = edge_table(space, types, props=False)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("vid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))
