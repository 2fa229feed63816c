"""Whole-graph algorithms over (src, dst) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.paths import bfs_levels
from weftgraph.runtime import forget, is_empty, settle


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src != dst").distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vid, component): the least vid of the weakly connected component. Labels spread and jump to their label's label.

    Each round joins tables as large as the graph. Their files are small for their rows, so a size test would send them to the
    driver to broadcast them, once a round; they are merged instead.
    """
    both = settle(undirected(edges), "undirected")
    ids = edges.select(F.col("src").alias("vid")).union(edges.select("dst"))
    if vertices is not None:
        ids = ids.union(vertices.select("vid"))
    labels = settle(ids.distinct().withColumn("component", F.col("vid")), "labels")
    while True:
        near = both.join(labels.hint("merge"), F.col("dst") == F.col("vid")).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), F.col("vid") == F.col("src"), "left").select("vid", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        root = labels.select(F.col("vid").alias("component"), F.col("component").alias("root"))
        new = settle(step.join(root.hint("merge"), "component", "left").select("vid", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        forget(labels)
        labels = new
        if is_empty(new.where("component < old")):
            forget(both)
            return labels.select("vid", "component")


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(vid, score): ranks that sum to 1; a vertex without out-edges spreads its rank evenly. Parallel edges count apart."""
    ids = edges.select(F.col("src").alias("vid")).union(edges.select("dst"))
    if vertices is not None:
        ids = ids.union(vertices.select("vid"))
    ids = settle(ids.distinct(), "vertices")
    n = ids.count()
    if n == 0:
        return ids.withColumn("score", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    flows = settle(edges.groupBy("src", "dst").agg(F.count("*").alias("k")).join(degree, "src").select("src", "dst", (F.col("k") / F.col("degree")).alias("share")), "flows")
    dangling = settle(ids.join(degree, F.col("vid") == F.col("src"), "left_anti"), "dangling")
    scores = settle(ids.withColumn("score", F.lit(1.0 / n)), "scores")
    for _ in range(most):
        lost = scores.join(dangling, "vid", "left_semi").agg(F.sum("score")).first()[0] or 0.0
        got = flows.join(scores, F.col("src") == F.col("vid")).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        new = scores.join(got, F.col("vid") == F.col("dst"), "left").select("vid", F.col("score").alias("old"), (F.coalesce("got", F.lit(0.0)) * damping + base).alias("score"))
        new = settle(new, "scores")
        moved = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        forget(scores)
        scores = new.select("vid", "score")
        scores._weft_path = new._weft_path
        if moved < tolerance:
            break
    return scores.select("vid", "score")


def bfs(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(source, vid, distance) within ``depth`` steps, edges taken as undirected."""
    return bfs_levels(undirected(edges).select(F.col("src").alias("here"), F.col("dst").alias("there")), start, depth)


def triangles(edges: DataFrame) -> DataFrame:
    """(vid, triangles) over the undirected graph; each edge points to its end of higher degree, which bounds the wedges."""
    both = settle(undirected(edges), "undirected")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    ranked = both.join(degree.select("src", F.col("d").alias("ds")), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    up = settle(ranked.where(F.struct("ds", "src") < F.struct("dd", "dst")).select(F.col("src").alias("a"), F.col("dst").alias("b")), "oriented")
    wedge = up.join(up.select("a", F.col("b").alias("c")), "a").where(F.col("b") < F.col("c"))
    closed = up.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    found = wedge.join(closed, ["b", "c"])
    return found.select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count("*").alias("triangles"))
