"""Path search as loops over settled tables: only a loop's end test reaches the driver."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.traversal import directed
from weftgraph.runtime import forget, is_empty, settle

#: Levels of a search that are read as files of their own before they are written together.
LEVELS_A_TABLE = 8


def rounds(most: int | None):
    """1, 2 and so on: up to ``most``, or until the caller breaks off."""
    return range(1, most + 1) if most is not None else count(1)


def bfs_levels(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, vid, distance) for every vertex within ``most`` steps of each source (None: all that are reached). ``edges`` is directed."""
    pairs = edges.select("here", "there").distinct()
    seen = settle(sources.select(F.col(sources.columns[0]).alias("source"), F.col(sources.columns[0]).alias("vid"), F.lit(0).alias("distance")).distinct(), "seen")
    edge = seen
    for step in rounds(most):
        hop = edge.join(pairs, F.col("vid") == F.col("here")).select("source", F.col("there").alias("vid")).distinct()
        new = settle(hop.join(seen.select("source", "vid"), ["source", "vid"], "left_anti").withColumn("distance", F.lit(step)), "level")
        if is_empty(new):
            break
        seen, edge = seen.unionByName(new), new
        if step % LEVELS_A_TABLE == 0:
            seen = settle(seen, "seen")
    return seen


class Side:
    """One end of a search: the complete levels of vertices around each start, each vertex with its least walk."""

    def __init__(self, starts: DataFrame, pairs: DataFrame, backward: bool):
        first = F.col(starts.columns[0])
        self.pairs, self.backward, self.depth = pairs, backward, 0
        self.level = settle(starts.select(first.alias("start"), first.alias("vid"), F.array(first).alias("nodes")).distinct(), "paths")
        self.seen = self.level.select("start", "vid")
        self.rows = self.level.count()

    def grow(self) -> None:
        """The next level: of the walks that meet at a vertex the least survives."""
        here, there = ("there", "here") if self.backward else ("here", "there")
        nodes = F.concat(F.array(there), "nodes") if self.backward else F.array_append("nodes", F.col(there))
        hop = self.level.join(self.pairs, F.col("vid") == F.col(here)).select("start", F.col(there).alias("vid"), nodes.alias("nodes"))
        new = settle(hop.join(self.seen, ["start", "vid"], "left_anti").groupBy("start", "vid").agg(F.min("nodes").alias("nodes")), "paths")
        self.level, self.depth, self.rows = new, self.depth + 1, new.count()
        self.seen = self.seen.unionByName(new.select("start", "vid"))
        if self.depth % LEVELS_A_TABLE == 0:
            self.seen = settle(self.seen, "seen")


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, length, nodes): one shortest path a pair, that of least vertex sequence; ``most`` bounds its length.

    Both ends search towards each other, the end with fewer vertices in its last level first. Levels are complete, so a pair of
    distance f + b has all its shortest paths through vertices that are in the f-th level of one end and the b-th of the other.
    The search ends when all pairs are found or one end has nothing left to reach.
    """
    pairs = edges.select("here", "there").distinct()
    ends = Side(sources, pairs, False), Side(targets, pairs, True)
    wanted, found, n_found = ends[0].rows * ends[1].rows, [], 0
    while True:
        f, b = (x.level.select(F.col("start").alias(n), "vid", F.col("nodes").alias(f"{n}_nodes")) for x, n in zip(ends, ("src", "dst"), strict=True))
        both = f.join(b, "vid").select("src", "dst", F.concat("src_nodes", F.slice("dst_nodes", F.lit(2), F.size("dst_nodes"))).alias("nodes"))
        for old in found:
            both = both.join(old.select("src", "dst"), ["src", "dst"], "left_anti")
        new = settle(both.groupBy("src", "dst").agg(F.min("nodes").alias("nodes")), "found")
        n = new.count()
        n_found += n
        if n or not found:
            found.append(new)
        if len(found) > LEVELS_A_TABLE:
            found = [settle(reduce(DataFrame.unionByName, found), "found")]
        depth = ends[0].depth + ends[1].depth
        if n_found == wanted or not (ends[0].rows and ends[1].rows) or depth == most:
            break
        min(ends, key=lambda x: x.rows).grow()
    out = reduce(DataFrame.unionByName, found)
    return out.select("src", "dst", (F.size("nodes") - 1).alias("length"), "nodes")


def weighted_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, weight: Column, most: int | None = None) -> DataFrame:
    """(src, dst, cost, nodes): a path of least cost a pair, that of least vertex sequence on ties.

    Relaxation in rounds until nothing improves, or over paths of up to ``most`` edges; only walks that may still improve on the
    dearest wanted target go on. A missing weight counts as 1 and a negative one is an error.
    """
    w = F.coalesce(weight.cast("double"), F.lit(1.0))
    w = F.when(w < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(w)
    light = edges.select("here", "there", w.alias("w")).groupBy("here", "there").agg(F.min("w").alias("w"))
    first = F.col(sources.columns[0])
    best = settle(sources.select(first.alias("source"), first.alias("vid"), F.lit(0.0).alias("cost"), F.array(first).alias("nodes")).distinct(), "best")
    edge = best
    wanted = settle(targets.select(F.col(targets.columns[0]).alias("vid")).distinct(), "targets")
    n_wanted = wanted.count()
    for _ in rounds(most):
        # Weights aren't negative: a walk dearer than all of its source's targets, once all are reached, is of no use.
        reached = best.join(F.broadcast(wanted) if n_wanted < 10_000 else wanted, "vid").groupBy(F.col("source").alias("s")).agg(F.max("cost").alias("most"), F.count("*").alias("n")).where(F.col("n") == n_wanted)
        edge = edge.join(reached, F.col("source") == F.col("s"), "left").where(F.col("most").isNull() | (F.col("cost") <= F.col("most"))).drop("s", "most", "n")
        hop = edge.join(light, F.col("vid") == F.col("here")).select("source", F.col("there").alias("vid"), (F.col("cost") + F.col("w")).alias("cost"), F.array_append("nodes", F.col("there")).alias("nodes"))
        least = hop.groupBy("source", "vid").agg(F.min(F.struct("cost", "nodes")).alias("n"))
        old = best.select("source", "vid", F.struct("cost", "nodes").alias("o"))
        both = settle(old.join(least, ["source", "vid"], "full").select("source", "vid", F.least("o", "n").alias("b"), (F.col("o").isNull() | (F.col("n") < F.col("o"))).alias("better")), "best")
        improved = both.where("better")
        forget(best)
        best = both.select("source", "vid", "b.cost", "b.nodes")
        best._weft_path = both._weft_path
        if is_empty(improved):
            break
        edge = improved.select("source", "vid", "b.cost", "b.nodes")
    return best.join(wanted, "vid").select(F.col("source").alias("src"), F.col("vid").alias("dst"), "cost", "nodes")


def all_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int, cycle: bool = False, loop: bool = False) -> DataFrame:
    """(src, dst, length, nodes, edges) of every path of up to ``most`` steps.

    Vertices don't repeat unless ``cycle``, edges never do; ``loop`` keeps self-loops. Partial paths that can't reach a target in
    the steps that are left are cut by their distance to the targets, searched backwards first.
    """
    step = F.struct("src", "dst", "rank", "type").alias("e")
    hops = edges.select("here", "there", step)
    if not loop:
        hops = hops.where(F.col("here") != F.col("there"))
    wanted = targets.select(F.col(targets.columns[0]).alias("vid")).distinct()
    back = hops.select(F.col("there").alias("here"), F.col("here").alias("there"))
    reach = settle(bfs_levels(back, wanted, most).groupBy("vid").agg(F.min("distance").alias("left")), "reach")
    first = F.col(sources.columns[0])
    at = sources.select(first.alias("source"), first.alias("at"), F.array(first).alias("nodes")).distinct().withColumn("edges", F.array().cast(f"array<{hops.schema['e'].dataType.simpleString()}>"))
    out = []
    for n in range(1, most + 1):
        grown = at.join(hops, F.col("at") == F.col("here"))
        self_loop = F.col("here") == F.col("there")
        fresh = ~F.array_contains("nodes", F.col("there"))
        closes = F.lit(cycle) | fresh | (self_loop if loop else F.lit(False))
        grown = grown.where(closes & ~F.array_contains("edges", F.col("e")))
        grown = grown.select("source", F.col("there").alias("at"), F.array_append("nodes", F.col("there")).alias("nodes"), F.array_append("edges", F.col("e")).alias("edges"))
        grown = grown.join(reach.where(F.col("left") <= most - n), F.col("at") == F.col("vid"), "left_semi")
        at = settle(grown, "walks")
        if is_empty(at):
            break
        out.append(at.join(wanted, F.col("at") == F.col("vid")).select(F.col("source").alias("src"), F.col("at").alias("dst"), F.lit(n).alias("length"), "nodes", "edges"))
    if not out:
        return at.select(F.col("source").alias("src"), F.col("at").alias("dst"), F.lit(0).alias("length"), "nodes", "edges").limit(0)
    return reduce(DataFrame.unionByName, out)


def subgraph(edges: DataFrame, sources: DataFrame, steps: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(vertices with their distance, edges both of whose ends are within ``steps`` of a source)."""
    levels = bfs_levels(directed(edges, direction), sources, steps).groupBy("vid").agg(F.min("distance").alias("distance"))
    levels = settle(levels, "levels")
    kept = edges.join(levels.select(F.col("vid").alias("src")), "src", "left_semi").join(levels.select(F.col("vid").alias("dst")), "dst", "left_semi")
    return levels, kept.select(*edges.columns)
