"""Projection, joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import relational
from weftgraph.suite.base import query, table, text_query

# -- projection, filter, expressions
text_query("project_expressions", "MATCH (l:orders) RETURN l.o_orderkey AS k, l.o_totalprice * 2 - 1 AS a, l.o_orderkey % 7 AS m, l.o_orderkey / 7 AS d, -l.o_custkey AS n, l.o_totalprice ** 2 AS p, l.o_orderstatus || '-' || l.o_orderpriority AS c", "SELECT o_orderkey AS k, o_totalprice * 2 - 1 AS a, o_orderkey % 7 AS m, o_orderkey // 7 AS d, -o_custkey AS n, o_totalprice ** 2 AS p, o_orderstatus || '-' || o_orderpriority AS c FROM orders")
text_query("filter_logic", "MATCH (c:customer) WHERE (c.c_acctbal > 5000 XOR c.c_mktsegment = 'BUILDING') AND NOT c.c_nationkey IN [1, 2, 3] RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE (c_acctbal > 5000) <> (c_mktsegment = 'BUILDING') AND c_nationkey NOT IN (1, 2, 3)")
text_query("filter_strings", "MATCH (p:part) WHERE p.p_type CONTAINS 'A' AND p.p_brand STARTS WITH 'Brand#1' AND NOT p.p_name ENDS WITH '9' AND p.p_name =~ '%0%' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'A') AND starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_name, '9') AND p_name LIKE '%0%'")
text_query("filter_null_tests", "MATCH (e:event) WHERE e.props IS NOT NULL AND NOT e.props IS EMPTY RETURN count(*) AS n", "SELECT count(*) AS n FROM events WHERE props IS NOT NULL AND props <> ''")
text_query("case_expressions", "MATCH (o:orders) RETURN CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o.o_totalprice > 250000 THEN 1 ELSE 0 END AS big, count(*) AS n", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS big, count(*) AS n FROM orders GROUP BY ALL")
text_query("cast_expressions", "MATCH (c:customer) RETURN c.c_custkey AS k, CAST(c.c_acctbal AS INT) AS i, CAST(c.c_nationkey AS STRING) AS s, TRY_CAST(c.c_name AS INT) AS t", "SELECT c_custkey AS k, trunc(c_acctbal)::BIGINT AS i, c_nationkey::VARCHAR AS s, NULL::BIGINT AS t FROM customer")
text_query("json_operators", "MATCH (e:event) RETURN e.event_id AS k, CAST(e.props -> 'k' AS INT) AS v, e.props #>> '{k}' AS t", "SELECT event_id AS k, (props ->> '$.k')::BIGINT AS v, props ->> '$.k' AS t FROM events")
text_query("list_expressions", "RETURN [x IN [1,2,3,4] WHERE x % 2 = 0 | x * 10] AS c, [1,2,3][1] AS i, [1,2,3,4][1..3] AS s, all(x IN [1,2] WHERE x > 0) AS al, any(x IN [1,2] WHERE x > 1) AS an, none(x IN [1,2] WHERE x > 5) AS no, reduce(t = 0, x IN [1,2,3] | t + x) AS r, [1,2,2] UNION [2,3] AS u, [1,2,2] INTERSECT [2] AS n, [1,2,2,3] EXCEPT [2] AS e", "SELECT [20, 40] AS c, 2 AS i, [2, 3] AS s, true AS al, true AS an, true AS no, 6::BIGINT AS r, [1,2,2,2,3] AS u, [2,2] AS n, [1,3] AS e")
text_query("parameters", "MATCH (c:customer) WHERE c.c_nationkey IN $keys AND c.c_acctbal > $low RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (1, 5) AND c_acctbal > 100", keys=[1, 5], low=100)
text_query("unwind", "UNWIND [1, 2, 2, 3] AS x RETURN x, x * x AS y", "SELECT x, x * x AS y FROM (VALUES (1), (2), (2), (3)) t(x)")
text_query("unwind_joined", "UNWIND [0, 1] AS k MATCH (r:region) WHERE r.r_regionkey = k RETURN k, r.r_name AS n", "SELECT r_regionkey AS k, r_name AS n FROM region WHERE r_regionkey IN (0, 1)")
text_query("yield_standalone", "YIELD 1 + 1 AS r, 'a' AS s", "SELECT 2 AS r, 'a' AS s")


# -- joins
@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), [("s_nationkey", "n_nationkey")], "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_custkey < 200) ON s_suppkey = c_custkey")
def join_full_outer(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "supplier").where("s_acctbal > 0"), table(spark, sf_dir, "customer").where("c_custkey < 200"), [("s_suppkey", "c_custkey")], "full").select("s_suppkey", "c_custkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf_dir):
    return relational.cross(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_left_semi(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_left_anti(spark, sf_dir):
    return relational.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


@query("SELECT l.l_orderkey AS k, o.o_custkey AS c FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey")
def join_multi_key(spark, sf_dir):
    out = relational.join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), [("l_orderkey", "o_orderkey"), ("l_suppkey", "o_custkey")])
    return out.select(F.col("l_orderkey").alias("k"), F.col("o_custkey").alias("c"))


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k FROM customer) a JOIN (SELECT CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(spark, sf_dir):
    gap = lambda c: F.when(F.col(c) != 3, F.col(c)).alias("k")
    return relational.count_join(table(spark, sf_dir, "customer").select(gap("c_nationkey")), table(spark, sf_dir, "supplier").select(gap("s_nationkey")), [("k", "k")], null_safe=True)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def pattern_apply(spark, sf_dir):
    return relational.pattern_apply(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 350000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def pattern_apply_no_key(spark, sf_dir):
    return relational.pattern_apply(table(spark, sf_dir, "region"), table(spark, sf_dir, "orders").where("o_totalprice < 0"), [], anti=True).select("r_name")


@query("SELECT n_nationkey, coalesce((SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), []) AS suppliers FROM nation")
def rollup_apply(spark, sf_dir):
    return relational.rollup_apply(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "supplier"), [("n_nationkey", "s_nationkey")], "s_suppkey", "suppliers")


@query("SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)")
def apply_lateral(spark, sf_dir):
    return relational.apply(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), [("r_regionkey", "n_regionkey")]).select("r_name", "n_name")


@query("SELECT o_orderkey, c_name AS v_c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def append_vertices(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "vid")
    return relational.append_vertices(table(spark, sf_dir, "orders"), "o_custkey", customers, "v_").select("o_orderkey", "v_c_name")


# -- aggregation
text_query("agg_group_by", "MATCH (o:orders) RETURN o.o_orderstatus AS s, count(*) AS n, sum(o.o_totalprice) AS t, avg(o.o_totalprice) AS a, min(o.o_totalprice) AS lo, max(o.o_totalprice) AS hi", "SELECT o_orderstatus AS s, count(*) AS n, sum(o_totalprice) AS t, avg(o_totalprice) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
text_query("agg_group_expression", "LOOKUP ON orders YIELD orders.o_custkey AS c, orders.o_totalprice AS t | GROUP BY $-.c % 10 YIELD $-.c % 10 AS d, count(*) AS n HAVING n > 5", "SELECT o_custkey % 10 AS d, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5")
text_query("agg_rollup", "MATCH (c:customer) RETURN c.c_mktsegment AS s, c.c_nationkey AS k, count(*) AS n GROUP BY ROLLUP(c.c_mktsegment, c.c_nationkey)", "SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
text_query("agg_cube", "MATCH (c:customer) RETURN c.c_mktsegment AS s, c.c_nationkey AS k, sum(c.c_acctbal) AS t GROUP BY CUBE(c.c_mktsegment, c.c_nationkey)", "SELECT c_mktsegment AS s, c_nationkey AS k, sum(c_acctbal) AS t FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
text_query("agg_grouping_sets", "MATCH (c:customer) RETURN c.c_mktsegment AS s, c.c_nationkey AS k, count(*) AS n GROUP BY GROUPING SETS ((c.c_mktsegment), (c.c_nationkey), ())", "SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
text_query("agg_filter_distinct", "MATCH (o:orders) RETURN count(DISTINCT o.o_custkey) AS d, sum(DISTINCT o.o_custkey) AS sd, sum(o.o_totalprice) FILTER (WHERE o.o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o.o_totalprice > 100000) AS c", "SELECT count(DISTINCT o_custkey) AS d, sum(DISTINCT o_custkey)::BIGINT AS sd, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_totalprice > 100000) AS c FROM orders")
text_query("agg_collect", "MATCH (s:supplier) RETURN s.s_nationkey AS k, collect(s.s_suppkey) AS l, collect_set(s.s_suppkey % 5) AS st, group_concat(s.s_suppkey, '|') AS g, group_concat(s.s_name, ',') WITHIN GROUP (ORDER BY s.s_suppkey DESC) AS gd", "SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS l, list_sort(list(DISTINCT s_suppkey % 5)) AS st, string_agg(s_suppkey::VARCHAR, '|' ORDER BY s_suppkey) AS g, string_agg(s_name, ',' ORDER BY s_suppkey DESC) AS gd FROM supplier GROUP BY 1")
text_query("agg_statistics", "MATCH (c:customer) RETURN c.c_mktsegment AS s, round(std(c.c_acctbal), 6) AS sd, round(stddev_pop(c.c_acctbal), 6) AS sp, round(variance(c.c_acctbal), 3) AS vp, round(median(c.c_acctbal), 6) AS md, round(percentile(c.c_acctbal, 90), 6) AS p9, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY c.c_acctbal), 6) AS pc", "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 6) AS sd, round(stddev_pop(c_acctbal), 6) AS sp, round(var_pop(c_acctbal), 3) AS vp, round(median(c_acctbal), 6) AS md, round(quantile_cont(c_acctbal, 0.9), 6) AS p9, round(quantile_cont(c_acctbal, 0.25), 6) AS pc FROM customer GROUP BY 1")
text_query("agg_bits", "MATCH (c:customer) RETURN c.c_nationkey AS k, bit_and(c.c_custkey) AS a, bit_or(c.c_custkey) AS o, bit_xor(c.c_custkey) AS x, bool_and(c.c_acctbal > -1000) AS ba, bool_or(c.c_acctbal > 9900) AS bo", "SELECT c_nationkey AS k, bit_and(c_custkey) AS a, bit_or(c_custkey) AS o, bit_xor(c_custkey) AS x, bool_and(c_acctbal > -1000) AS ba, bool_or(c_acctbal > 9900) AS bo FROM customer GROUP BY 1")
text_query("agg_mode", "MATCH (p:part) RETURN p.p_brand AS b, mode(p.p_size) AS m", "SELECT b, min(s) AS m FROM (SELECT p_brand AS b, p_size AS s, count(*) AS n, max(count(*)) OVER (PARTITION BY p_brand) AS mx FROM part GROUP BY 1, 2) WHERE n = mx GROUP BY b")
text_query("agg_product", "MATCH (n:nation) RETURN n.n_regionkey AS r, product(n.n_nationkey + 1) AS p", "SELECT n_regionkey AS r, product(n_nationkey + 1) AS p FROM nation GROUP BY 1")
text_query("agg_vectors", "MATCH (e:embeddings) WHERE e.vec_id < 100 RETURN e.label AS l, [x IN vec_sum(e.embedding) | round(x, 4) + 0] AS s, [x IN vec_avg(e.embedding) | round(x, 4) + 0] AS a", "SELECT label AS l, list(round(s, 4) + 0 ORDER BY i) AS s, list(round(a, 4) + 0 ORDER BY i) AS a FROM (SELECT label, i, sum(embedding[i]::DOUBLE) AS s, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) WHERE vec_id < 100 GROUP BY 1, 2) GROUP BY 1")
text_query("agg_global_empty", "MATCH (c:customer) WHERE c.c_acctbal > 1000000 RETURN count(*) AS n, sum(c.c_acctbal) AS s", "SELECT count(*) AS n, sum(c_acctbal) AS s FROM customer WHERE c_acctbal > 1000000")
text_query("agg_mixed_expression", "MATCH (o:orders) RETURN o.o_orderstatus AS s, sum(o.o_totalprice) / count(*) AS m, max(o.o_totalprice) - min(o.o_totalprice) AS r", "SELECT o_orderstatus AS s, sum(o_totalprice) / count(*) AS m, max(o_totalprice) - min(o_totalprice) AS r FROM orders GROUP BY 1")

# -- windows
text_query("window_ranking", "MATCH (c:customer) RETURN c.c_custkey AS k, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS rn, rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_mktsegment) AS d, ntile(4) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS t", "SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer")
text_query("window_offsets", "MATCH (c:customer) RETURN c.c_custkey AS k, lead(c.c_acctbal) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS a, lag(c.c_acctbal, 2) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS b, first_value(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS f, last_value(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS l, nth_value(c.c_custkey, 3) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS n", "SELECT c_custkey AS k, lead(c_acctbal) OVER w AS a, lag(c_acctbal, 2) OVER w AS b, first_value(c_custkey) OVER f AS f, last_value(c_custkey) OVER f AS l, nth_value(c_custkey, 3) OVER f AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey), f AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
text_query("window_running", "MATCH (c:customer) RETURN c.c_custkey AS k, round(sum(c.c_acctbal) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY c.c_nationkey) AS n", "SELECT c_custkey AS k, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
text_query("window_over_aggregate", "MATCH (c:customer) RETURN c.c_nationkey AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r", "SELECT c_nationkey AS k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1")

# -- sort, limit, sample, dedup
text_query("top_n", "MATCH (o:orders) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 10")
text_query("skip_limit", "MATCH (o:orders) RETURN o.o_orderkey AS k ORDER BY k SKIP 5 LIMIT 7", "SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 7 OFFSET 5")
text_query("sort_rows", "MATCH (n:nation) RETURN n.n_name AS n, n.n_regionkey AS r ORDER BY r DESC, n", "SELECT n_name AS n, n_regionkey AS r FROM nation ORDER BY 2 DESC, 1")
text_query("distinct_rows", "MATCH (o:orders) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
text_query("sample_rows", "LOOKUP ON customer YIELD customer.c_custkey AS k | SAMPLE 20", None)


@query("SELECT c_custkey AS k FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, (SELECT count(*) FROM customer) // 20 AS s FROM customer) WHERE i % s = 0 ORDER BY 1 LIMIT 20")
def sample_system(spark, sf_dir):
    return relational.sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), 20, "system", key="k")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.dedup(orders, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")])


# -- set operations
_A, _B = "MATCH (c:customer) RETURN c.c_nationkey AS k", "MATCH (s:supplier) WHERE s.s_acctbal > 3000 RETURN s.s_nationkey AS k"
_SA, _SB = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000"
text_query("set_union", f"{_A} UNION {_B}", f"{_SA} UNION {_SB}")
text_query("set_union_all", f"{_A} UNION ALL {_B}", f"{_SA} UNION ALL {_SB}")
text_query("set_intersect", f"{_A} INTERSECT {_B}", f"{_SA} INTERSECT {_SB}")
text_query("set_minus", f"{_A} MINUS {_B}", f"{_SA} EXCEPT {_SB}")
text_query("set_intersect_rows", f"{_A} INTERSECT ALL {_B}", f"{_SA} WHERE c_nationkey IN ({_SB})")
text_query("set_minus_rows", f"{_A} MINUS ALL {_B}", f"{_SA} WHERE c_nationkey NOT IN ({_SB})")


@query("SELECT 'c' AS key, max(CASE WHEN r_regionkey = 0 THEN r_name END) AS \"0\", max(CASE WHEN r_regionkey = 1 THEN r_name END) AS \"1\" FROM region")
def transpose_rows(spark, sf_dir):
    out = relational.transpose(table(spark, sf_dir, "region").where("r_regionkey < 2").select("r_regionkey", F.col("r_name").alias("c")), "r_regionkey")
    return out.toDF("key", *out.columns[1:])
