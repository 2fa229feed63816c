"""Sources, user functions, streaming windows, time to live and recursion."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from weftgraph.functions import udf
from weftgraph.model import GraphSpace, Schema
from weftgraph.plans.translate import Translator
from weftgraph.runtime import shared_folder
from weftgraph.sources import files
from weftgraph.streaming import events as streaming
from weftgraph.suite.base import graph, query, table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path, df = _folder(spark), table(spark, sf_dir, "nation")
    files.export_csv(df, path, delimiter=";")
    return files.import_csv(spark, path, df.schema, delimiter=";")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_lines_round_trip(spark, sf_dir):
    path, df = _folder(spark), table(spark, sf_dir, "supplier")
    files.export_json(df, path)
    return files.import_json(spark, path, df.schema)


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def dump_restore(spark, sf_dir):
    full, small = graph(spark, sf_dir), GraphSpace(spark, "small")
    for n in ("nation", "region"):
        small.tags[n] = full.tag(n)
    small.edges["IN_REGION"] = full.edge("IN_REGION")
    path = _folder(spark)
    files.dump(small, path)
    return files.restore(spark, path).query("MATCH (n:nation)-[:IN_REGION]->(r:region) RETURN n.n_name AS n, r.r_name AS r")


@query("SELECT c_custkey AS k, c_acctbal * 2 AS d FROM customer")
def udf_vectorized(spark, sf_dir):
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    udf.register_vectorized("twice", twice, "double")
    return graph(spark, sf_dir).query("MATCH (c:customer) RETURN c.c_custkey AS k, twice(c.c_acctbal) AS d")


@query("SELECT c_nationkey AS k, round(max(c_acctbal) - min(c_acctbal), 4) AS s FROM customer GROUP BY 1")
def udf_aggregate(spark, sf_dir):
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    udf.register_aggregate("spread", spread, "double")
    return graph(spark, sf_dir).query("MATCH (c:customer) RETURN c.c_nationkey AS k, spread(c.c_acctbal) AS s").withColumn("s", F.round("s", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = streaming.run_once(streaming.tumbling(streaming.read_stream(spark, f"{sf_dir}/events.parquet"), "1 day", late="2 days"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END), date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -1 END)]) AS s FROM events) GROUP BY ALL")
def window_sliding(spark, sf_dir):
    out = streaming.tumbling(table(spark, sf_dir, "events"), "1 day", slide="12 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, sid")
def window_sessions(spark, sf_dir):
    out = streaming.sessions(table(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey % 2 = 0")
def ttl_filter(spark, sf_dir):
    """Orders of odd customers carry a stamp that has run out."""
    df = table(spark, sf_dir, "orders").withColumn("seen", F.when(F.col("o_custkey") % 2 == 0, F.unix_timestamp()).otherwise(F.lit(0)).cast("long"))
    space = GraphSpace(spark, "t").add_tag("orders", df, "o_orderkey", Schema(ttl_column="seen", ttl_seconds=3600))
    return space.query("MATCH (o:orders) RETURN count(*) AS n")


@query("WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION SELECT n * 2 FROM r WHERE n < 1000) SELECT n FROM r")
def recursion(spark, sf_dir):
    t = Translator(graph(spark, sf_dir))
    start = spark.range(1, 2).select(F.col("id").alias("n"))
    return t.recursive(start, lambda new: new.where("n < 1000").select((F.col("n") * 2).alias("n")))
