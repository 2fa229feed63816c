"""The registry and the graph over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import GraphSpace, Index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> GraphSpace:
    """Tags and edge types over the tables; nothing is read until a query asks for it."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")}
    g = GraphSpace(spark, "shop")
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("embeddings", "vec_id")):
        g.add_tag(name, t[name].withColumn(key, F.col(key).cast("long")), key)
    g.add_tag("event", t["events"], "event_id")
    g.add_tag("user", t["events"].select(F.col("user_id")).distinct(), "user_id")
    long = lambda c: F.col(c).cast("long")
    g.add_edge("IN_REGION", t["nation"].select(long("n_nationkey").alias("a"), long("n_regionkey").alias("b")), "a", "b", None, "nation", "region")
    g.add_edge("LIVES_IN", t["customer"].select(long("c_custkey").alias("a"), long("c_nationkey").alias("b")), "a", "b", None, "customer", "nation")
    g.add_edge("BASED_IN", t["supplier"].select(long("s_suppkey").alias("a"), long("s_nationkey").alias("b")), "a", "b", None, "supplier", "nation")
    g.add_edge("PLACED", t["orders"].select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_orderkey", None, "customer", "orders")
    g.add_edge("CONTAINS", t["lineitem"].drop("l_suppkey"), "l_orderkey", "l_partkey", "l_linenumber", "orders", "part")
    g.add_edge("SUPPLIED_BY", t["lineitem"].select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), "l_partkey", "l_suppkey", "l_linenumber", "part", "supplier")
    g.add_edge("DID", t["events"].select("user_id", "event_id", "event_type", "value"), "user_id", "event_id", None, "user", "event")
    # A homogeneous graph: the i-th customer knows those 1, 7 and 31 keys on who share its market segment.
    c = t["customer"].select("c_custkey", "c_mktsegment")
    hop = c.select("c_custkey", "c_mktsegment", F.explode(F.array(F.lit(1), F.lit(7), F.lit(31))).alias("step")).withColumn("other", F.col("c_custkey") + F.col("step"))
    d = c.select(F.col("c_custkey").alias("other"), F.col("c_mktsegment").alias("seg"))
    knows = hop.join(d, "other").where("c_mktsegment = seg").select("c_custkey", "other", F.col("step").cast("long").alias("step"), (F.col("step") * 0.5).alias("weight"))
    g.add_edge("KNOWS", knows, "c_custkey", "other", None, "customer", "customer")
    g.indexes["doc_text"] = Index("doc_text", "FULLTEXT", "documents", ("text",), {})
    g.indexes["vec"] = Index("vec", "VECTOR", "embeddings", ("embedding",), {"distance": "COSINE"})
    for metric in ("EUCLID", "DOT", "MANHATTAN"):
        g.indexes[f"vec_{metric.lower()}"] = Index(f"vec_{metric.lower()}", "VECTOR", "embeddings", ("embedding",), {"distance": metric})
    return g


#: KNOWS as SQL.
KNOWS = "(SELECT a.c_custkey AS src, b.c_custkey AS dst, s.step AS step, s.step * 0.5 AS weight FROM customer a, (VALUES (1), (7), (31)) s(step), customer b WHERE b.c_custkey = a.c_custkey + s.step AND a.c_mktsegment = b.c_mktsegment)"


def text_query(name: str, text: str, sql: str | None, **params: object) -> None:
    """Register a query of the language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph(spark, sf_dir).query(text, **params)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name."""

    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep
