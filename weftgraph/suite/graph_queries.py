"""Scans, patterns, traversal, paths, algorithms and data changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import algorithms, paths, traversal
from weftgraph.suite.base import KNOWS, graph, query, text_query

# -- scans
text_query("scan_vertices", "MATCH (n:nation) RETURN id(n) AS vid, n.n_name AS name", "SELECT n_nationkey::BIGINT AS vid, n_name AS name FROM nation")
text_query("scan_vertices_untagged", "MATCH (v) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) AS n")
text_query("get_vertices", "FETCH PROP ON customer 1, 2, 3 YIELD customer.c_name AS name, customer.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey IN (1, 2, 3)")
text_query("scan_edges", "LOOKUP ON CONTAINS YIELD src(edge) AS o, dst(edge) AS p, CONTAINS.l_quantity AS q", "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS q FROM lineitem")
text_query("get_edges", "FETCH PROP ON IN_REGION 0 -> 0, 1 -> 1, 2 -> 1, 3 -> 1, 4 -> 4, 5 -> 0 YIELD src(edge) AS s, dst(edge) AS d", "SELECT n_nationkey::BIGINT AS s, n_regionkey::BIGINT AS d FROM nation WHERE (n_nationkey, n_regionkey) IN ((0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 0))")
text_query("lookup_unique", "LOOKUP ON customer WHERE customer.c_name == 'Customer#000000007' YIELD customer.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_name = 'Customer#000000007'")
text_query("lookup_prefix", "LOOKUP ON part WHERE part.p_type STARTS WITH 'S' YIELD part.p_partkey AS k, part.p_type AS t", "SELECT p_partkey AS k, p_type AS t FROM part WHERE starts_with(p_type, 'S')")
text_query("lookup_range", "LOOKUP ON customer WHERE customer.c_acctbal >= 1000 AND customer.c_acctbal < 2000 YIELD customer.c_custkey AS k, customer.c_acctbal AS b", "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000")
text_query("lookup_edge_index", "LOOKUP ON CONTAINS WHERE CONTAINS.l_quantity > 45 YIELD src(edge) AS o, dst(edge) AS p", "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity > 45")


@query("SELECT o_custkey AS vid, o_orderkey AS neighbor, 'PLACED' AS type, 0::BIGINT AS rank FROM orders WHERE o_custkey < 20")
def get_neighbors(spark, sf_dir):
    g = graph(spark, sf_dir)
    return traversal.neighbors(g, g.tag("customer").df.where("vid < 20"), ["PLACED"])


@query("SELECT n_nationkey::BIGINT AS vid, c_custkey AS neighbor FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 3")
def get_neighbors_in(spark, sf_dir):
    g = graph(spark, sf_dir)
    return traversal.neighbors(g, g.tag("nation").df.where("vid < 3"), ["LIVES_IN"], "in").select("vid", "neighbor")


# -- MATCH
text_query("match_one_hop", "MATCH (c:customer)-[:LIVES_IN]->(n:nation) WHERE c.c_acctbal > 0 RETURN n.n_name AS nation, count(*) AS customers", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
text_query("match_three_hops", "MATCH (c:customer)-[:PLACED]->(o:orders)-[l:CONTAINS]->(p:part) WHERE o.o_orderstatus = 'F' RETURN c.c_mktsegment AS seg, p.p_brand AS brand, sum(l.l_quantity) AS q", "SELECT c_mktsegment AS seg, p_brand AS brand, sum(l_quantity) AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY ALL")
text_query("match_inline_props", "MATCH (r:region {r_name: 'ASIA'})<-[:IN_REGION]-(n:nation)<-[:BASED_IN]-(s:supplier) RETURN n.n_name AS nation, s.s_name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name = 'ASIA'")
text_query("match_both_directions", "MATCH (a:customer)-[:KNOWS]-(b:customer) WHERE a.c_custkey < 50 RETURN a.c_custkey AS a, b.c_custkey AS b", f"SELECT src AS a, dst AS b FROM {KNOWS} WHERE src < 50 UNION ALL SELECT dst, src FROM {KNOWS} WHERE dst < 50")
text_query("match_types_either", "MATCH (x)-[e:LIVES_IN|BASED_IN]->(n:nation) RETURN n.n_name AS nation, type(e) AS t, count(*) AS c", "SELECT n_name AS nation, 'LIVES_IN' AS t, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL UNION ALL SELECT n_name, 'BASED_IN', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
text_query("match_repeated_variable", "MATCH (s:supplier)-[:BASED_IN]->(n:nation)<-[:LIVES_IN]-(c:customer), (c)-[:PLACED]->(o:orders) WHERE s.s_suppkey < 5 RETURN s.s_suppkey AS s, count(*) AS c", "SELECT s_suppkey AS s, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE s_suppkey < 5 GROUP BY s_suppkey")
text_query("match_comma_patterns", "MATCH (r:region), (n:nation) WHERE n.n_regionkey = r.r_regionkey RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region, nation WHERE n_regionkey = r_regionkey")
text_query("match_optional", "MATCH (c:customer) OPTIONAL MATCH (c)-[:PLACED]->(o:orders) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, count(o) AS n", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
text_query("match_var_length", "MATCH (a:customer)-[e:KNOWS*1..3]->(b:customer) WHERE a.c_custkey < 30 RETURN a.c_custkey AS a, b.c_custkey AS b, size(e) AS hops", f"WITH RECURSIVE k AS {KNOWS}, w(a, b, hops) AS (SELECT src, dst, 1 FROM k WHERE src < 30 UNION ALL SELECT a, dst, hops + 1 FROM w JOIN k ON src = b WHERE hops < 3) SELECT a, b, hops FROM w")
text_query("match_var_length_zero", "MATCH (a:customer)-[:KNOWS*0..1]->(b:customer) WHERE a.c_custkey < 30 RETURN a.c_custkey AS a, b.c_custkey AS b", f"SELECT src AS a, dst AS b FROM {KNOWS} WHERE src < 30 UNION ALL SELECT c_custkey, c_custkey FROM customer WHERE c_custkey < 30")
text_query("match_var_length_unbounded", "MATCH (n:nation)-[e:IN_REGION*]->(r) RETURN id(n) AS n, size(e) AS hops, count(*) AS c", "SELECT n_nationkey::BIGINT AS n, 1 AS hops, count(*) AS c FROM nation GROUP BY ALL")
text_query("match_path_value", "MATCH p = (n:nation)-[:IN_REGION]->(r:region) RETURN nodes(p) AS nodes, length(p) AS len", "SELECT [n_nationkey, n_regionkey] AS nodes, 1 AS len FROM nation")
text_query("match_exists", "MATCH (c:customer) WHERE EXISTS {MATCH (c)-[:PLACED]->(o:orders) WHERE o.o_totalprice > 400000} RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
text_query("match_not_exists", "MATCH (c:customer) WHERE NOT EXISTS {MATCH (c)-[:PLACED]->(o)} RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
text_query("match_exists_or", "MATCH (c:customer) WHERE c.c_acctbal > 9000 OR EXISTS {MATCH (c)-[:PLACED]->(o:orders) WHERE o.o_totalprice > 400000} RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
text_query("match_in_subquery", "MATCH (n:nation) WHERE n.n_nationkey IN {MATCH (s:supplier) WHERE s.s_acctbal > 5000 RETURN s.s_nationkey} RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
text_query("match_not_in_subquery", "MATCH (n:nation) WHERE n.n_nationkey NOT IN {MATCH (s:supplier) WHERE s.s_acctbal > 5000 RETURN s.s_nationkey} RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
text_query("match_element_functions", "MATCH (c:customer)-[e:LIVES_IN]->(n:nation) WHERE c.c_custkey < 10 RETURN id(c) AS c, src(e) AS s, dst(e) AS d, rank(e) AS r, type(e) AS t, tags(n) AS tg, keys(n) AS k", "SELECT c_custkey AS c, c_custkey AS s, c_nationkey::BIGINT AS d, 0::BIGINT AS r, 'LIVES_IN' AS t, ['nation'] AS tg, ['n_name', 'n_nationkey', 'n_regionkey'] AS k FROM customer WHERE c_custkey < 10")
text_query("with_having_chain", "MATCH (c:customer)-[:PLACED]->(o:orders) WITH c, count(o) AS n, sum(o.o_totalprice) AS total WHERE n > 12 MATCH (c)-[:LIVES_IN]->(x:nation) RETURN x.n_name AS nation, count(*) AS customers, max(n) AS most", "SELECT n_name AS nation, count(*) AS customers, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")

# -- GO, FETCH, LOOKUP and pipes
text_query("go_one_step", "GO FROM 1, 2, 3 OVER PLACED WHERE PLACED.o_totalprice > 1000 YIELD src(edge) AS c, dst(edge) AS o, PLACED.o_totalprice AS t", "SELECT o_custkey AS c, o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_custkey IN (1, 2, 3) AND o_totalprice > 1000")
text_query("go_two_steps", "GO 2 STEPS FROM 1 OVER KNOWS YIELD dst AS d", f"WITH k AS {KNOWS} SELECT DISTINCT b.dst AS d FROM k a JOIN k b ON b.src = a.dst WHERE a.src = 1")
text_query("go_step_range", "GO 1 TO 3 STEPS FROM 1 OVER KNOWS YIELD dst AS d", f"WITH RECURSIVE k AS {KNOWS}, w(d, n) AS (SELECT dst, 1 FROM k WHERE src = 1 UNION ALL SELECT dst, n + 1 FROM w JOIN k ON src = d WHERE n < 3) SELECT DISTINCT d FROM w")
text_query("go_reversely", "GO FROM 3 OVER LIVES_IN REVERSELY YIELD dst AS c, $$.customer.c_name AS name", "SELECT c_custkey AS c, c_name AS name FROM customer WHERE c_nationkey = 3")
text_query("go_bidirect", "GO FROM 10 OVER KNOWS BIDIRECT YIELD dst AS d", f"SELECT dst AS d FROM {KNOWS} WHERE src = 10 UNION ALL SELECT src FROM {KNOWS} WHERE dst = 10")
text_query("go_target_filter", "GO FROM 1, 2, 3, 4 OVER PLACED WHERE target.o_orderstatus == 'O' YIELD $^.customer.c_name AS name, target.o_totalprice AS t", "SELECT c_name AS name, o_totalprice AS t FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (1, 2, 3, 4) AND o_orderstatus = 'O'")
text_query("go_pipe_go", "GO FROM 5 OVER PLACED YIELD dst AS o | GO FROM $-.o OVER CONTAINS YIELD $-.o AS o, dst AS p, CONTAINS.l_quantity AS q", "SELECT o_orderkey AS o, l_partkey AS p, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 5")
text_query("go_pipe_group", "GO FROM 1, 2, 3 OVER PLACED YIELD src(edge) AS c, PLACED.o_totalprice AS t | GROUP BY $-.c YIELD $-.c AS c, count(*) AS n, max($-.t) AS m", "SELECT o_custkey AS c, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_custkey IN (1, 2, 3) GROUP BY 1")
text_query("go_pipe_order_limit", "GO FROM 1, 2, 3, 4, 5 OVER PLACED YIELD dst AS o, PLACED.o_totalprice AS t | ORDER BY $-.t DESC, $-.o | LIMIT 5", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5) ORDER BY t DESC, o LIMIT 5")
text_query("lookup_pipe_fetch", "LOOKUP ON customer WHERE customer.c_acctbal > 9900 YIELD id(vertex) AS v | FETCH PROP ON customer $-.v YIELD customer.c_name AS n", "SELECT c_name AS n FROM customer WHERE c_acctbal > 9900")
text_query("variable_assign", "$a = GO FROM 1 OVER KNOWS YIELD dst AS d; GO FROM $a.d OVER PLACED YIELD dst AS o", f"SELECT o_orderkey AS o FROM orders WHERE o_custkey IN (SELECT dst FROM {KNOWS} WHERE src = 1)")


@query(f"WITH k AS {KNOWS} SELECT DISTINCT b.src, b.dst FROM k a JOIN k b ON b.src = a.dst WHERE a.src < 20")
def expand_two_hops(spark, sf_dir):
    g = graph(spark, sf_dir)
    edges = traversal.directed(traversal.edge_table(g, ["KNOWS"]), "out")
    return traversal.expand(edges, g.tag("customer").df.where("vid < 20").select("vid"), 2, 2).select("src", "dst").distinct()


@query()
def expand_sampled(spark, sf_dir):
    """At most two edges a vertex and step, chosen by hash: what is chosen isn't SQL's business, so rows only."""
    g = graph(spark, sf_dir)
    edges = traversal.directed(traversal.edge_table(g, ["KNOWS"]), "out")
    return traversal.expand_sampled(edges, g.tag("customer").df.where("vid < 20").select("vid"), 2, 2).select("src", "dst", "step")


@query(f"SELECT vid, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT src AS vid, 1 AS o, 0 AS i FROM {KNOWS} UNION ALL SELECT dst, 0, 1 FROM {KNOWS}) GROUP BY vid")
def degrees(spark, sf_dir):
    return traversal.degrees(graph(spark, sf_dir), ["KNOWS"])


# -- paths
_BFS = f"WITH RECURSIVE k AS {KNOWS}, w(s, v, n) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey IN ({{ids}}) UNION SELECT s, dst, n + 1 FROM w JOIN k ON src = v WHERE n < {{most}})"
text_query("shortest_path", "FIND SHORTEST PATH FROM 1, 2 TO 40, 63 OVER KNOWS UPTO 12 STEPS YIELD src AS a, dst AS b, length AS n", _BFS.format(ids="1, 2", most=12) + " SELECT s AS a, v AS b, min(n) AS n FROM w WHERE v IN (40, 63) GROUP BY 1, 2")
text_query("shortest_path_weighted", "FIND SHORTEST PATH FROM 1, 2 TO 40, 63 OVER KNOWS WEIGHT weight UPTO 12 STEPS YIELD src AS a, dst AS b, cost AS c", f"WITH RECURSIVE k AS {KNOWS}, w(s, v, c, n) AS (SELECT c_custkey, c_custkey, 0::DOUBLE, 0 FROM customer WHERE c_custkey IN (1, 2) UNION SELECT s, dst, c + weight, n + 1 FROM w JOIN k ON src = v WHERE n < 12 AND dst <= 63) SELECT s AS a, v AS b, min(c) AS c FROM w WHERE v IN (40, 63) GROUP BY 1, 2")
text_query("all_paths", "FIND ALL PATH FROM 1 TO 40, 63 OVER KNOWS UPTO 5 STEPS YIELD dst AS b, nodes AS p", f"WITH RECURSIVE k AS {KNOWS}, w(v, p) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT dst, list_append(p, dst) FROM w JOIN k ON src = v WHERE len(p) <= 5 AND NOT list_contains(p, dst)) SELECT v AS b, p FROM w WHERE v IN (40, 63)")
text_query("all_paths_both", "FIND ALL PATH FROM 1 TO 9 OVER KNOWS BIDIRECT UPTO 3 STEPS YIELD dst AS b, nodes AS p", f"WITH RECURSIVE e AS {KNOWS}, k AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), w(v, p) AS (SELECT 1::BIGINT, [1::BIGINT] UNION ALL SELECT dst, list_append(p, dst) FROM w JOIN k ON src = v WHERE len(p) <= 3 AND NOT list_contains(p, dst)) SELECT v AS b, p FROM w WHERE v = 9")
text_query("subgraph_vertices", "GET SUBGRAPH 2 STEPS FROM 10 OVER KNOWS YIELD kind, vid, distance WHERE kind = 'vertex'", f"WITH RECURSIVE e AS {KNOWS}, k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(v, n) AS (SELECT 10::BIGINT, 0 UNION SELECT dst, n + 1 FROM w JOIN k ON src = v WHERE n < 2) SELECT 'vertex' AS kind, v AS vid, min(n) AS distance FROM w GROUP BY v")
text_query("subgraph_edges", "GET SUBGRAPH 2 STEPS FROM 10 OVER KNOWS YIELD src, dst WHERE kind = 'edge'", f"WITH RECURSIVE e AS {KNOWS}, k AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(v, n) AS (SELECT 10::BIGINT, 0 UNION SELECT dst, n + 1 FROM w JOIN k ON src = v WHERE n < 2), s AS (SELECT DISTINCT v FROM w) SELECT src, dst FROM e WHERE src IN (FROM s) AND dst IN (FROM s)")


@query(_BFS.format(ids="1, 10", most=4) + " SELECT s AS source, v AS vid, min(n) AS distance FROM w GROUP BY 1, 2")
def bfs_levels(spark, sf_dir):
    g = graph(spark, sf_dir)
    edges = traversal.directed(traversal.edge_table(g, ["KNOWS"]), "out")
    return paths.bfs_levels(edges, g.tag("customer").df.where("vid IN (1, 10)").select("vid"), 4)


# -- algorithms
@query(f"WITH RECURSIVE e AS {KNOWS}, k AS (SELECT src, dst FROM e WHERE src < 400 AND dst < 400), u AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k), r(v, c) AS (SELECT src, src FROM u UNION SELECT u.dst, r.c FROM r JOIN u ON u.src = r.v WHERE r.c < u.dst) SELECT v AS vid, min(c) AS component FROM r GROUP BY v")
def connected_components(spark, sf_dir):
    """Over the customers below 400 only to keep the checking SQL's closure small; the operator has no such bound."""
    edges = traversal.edge_table(graph(spark, sf_dir), ["KNOWS"]).where("src < 400 AND dst < 400")
    return algorithms.connected_components(edges)


@query(f"SELECT count(*) AS n FROM (SELECT src AS v FROM {KNOWS} UNION SELECT dst FROM {KNOWS})")
def connected_components_all(spark, sf_dir):
    return algorithms.connected_components(traversal.edge_table(graph(spark, sf_dir), ["KNOWS"])).agg(F.count("*").alias("n"))


_RANK = ", ".join(
    f"p{i} AS (SELECT v, 0.15 / (SELECT n FROM c) + 0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(s), 0) FROM p{i - 1} WHERE v NOT IN (SELECT src FROM o)) / (SELECT n FROM c)) AS s FROM p{i - 1} LEFT JOIN (SELECT k.dst AS d, sum(p.s / o.d) AS g FROM k JOIN p{i - 1} p ON p.v = k.src JOIN o ON o.src = k.src GROUP BY 1) ON d = v)"
    for i in range(1, 6)
)


@query(f"WITH k AS MATERIALIZED {KNOWS}, ids AS (SELECT src AS v FROM k UNION SELECT dst FROM k), c AS (SELECT count(*) AS n FROM ids), o AS (SELECT src, count(*) AS d FROM k GROUP BY 1), p0 AS (SELECT v, 1.0::DOUBLE / (SELECT n FROM c) AS s FROM ids), {_RANK} SELECT v AS vid, round(s, 10) AS score FROM p5")
def pagerank_five_rounds(spark, sf_dir):
    scores = algorithms.pagerank(traversal.edge_table(graph(spark, sf_dir), ["KNOWS"]), most=5, tolerance=0.0)
    return scores.select("vid", F.round("score", 10).alias("score"))


@query(f"WITH e AS {KNOWS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b) SELECT vid, count(*) AS triangles FROM (SELECT a AS vid FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY vid")
def triangle_counts(spark, sf_dir):
    return algorithms.triangles(traversal.edge_table(graph(spark, sf_dir), ["KNOWS"]))


# -- data changes, seen through the next query
text_query("insert_vertices", "INSERT VERTEX region(r_regionkey, r_name) VALUES 90:(90, 'NORTH'), 0:(0, 'RENAMED'); MATCH (r:region) RETURN r.r_regionkey AS k, r.r_name AS n", "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey = 0 THEN 'RENAMED' ELSE r_name END AS n FROM region UNION ALL SELECT 90, 'NORTH'")
text_query("insert_if_not_exists", "INSERT VERTEX IF NOT EXISTS region(r_regionkey, r_name) VALUES 90:(90, 'NORTH'), 0:(0, 'RENAMED'); MATCH (r:region) RETURN r.r_regionkey AS k, r.r_name AS n", "SELECT r_regionkey::BIGINT AS k, r_name AS n FROM region UNION ALL SELECT 90, 'NORTH'")
text_query("insert_edges", "INSERT EDGE IN_REGION(a, b) VALUES 3 -> 0 @7:(3, 0); MATCH (n:nation)-[e:IN_REGION]->(r:region) WHERE n.n_nationkey = 3 RETURN r.r_regionkey AS r, rank(e) AS k", "SELECT n_regionkey::BIGINT AS r, 0::BIGINT AS k FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 0, 7")
text_query("update_vertex", "UPDATE VERTEX 5 ON customer SET c_acctbal = c_acctbal + 10 WHERE c_acctbal > -100000; MATCH (c:customer) WHERE c.c_custkey < 9 RETURN c.c_custkey AS k, round(c.c_acctbal, 4) AS b", "SELECT c_custkey AS k, round(c_acctbal + CASE WHEN c_custkey = 5 THEN 10 ELSE 0 END, 4) AS b FROM customer WHERE c_custkey < 9")
text_query("upsert_vertex", "UPSERT VERTEX 777 ON region SET r_name = 'NEW', r_regionkey = 777; MATCH (r:region) RETURN r.r_regionkey AS k, r.r_name AS n", "SELECT r_regionkey::BIGINT AS k, r_name AS n FROM region UNION ALL SELECT 777, 'NEW'")
text_query("update_edge_yield", "UPDATE EDGE 1 -> 2 @0 OF KNOWS SET weight = 9.5 YIELD KNOWS.weight AS w", None)
text_query("delete_vertex_with_edge", "DELETE VERTEX 3 WITH EDGE; MATCH (c:customer)-[:LIVES_IN]->(n:nation) RETURN n.n_name AS n, count(*) AS c", "SELECT n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey <> 3 AND c_custkey <> 3 GROUP BY 1")
text_query("delete_vertex_dangling", "DELETE VERTEX 3; GO FROM 3 OVER LIVES_IN REVERSELY YIELD dst AS c", "SELECT c_custkey AS c FROM customer WHERE c_nationkey = 3")
text_query("delete_edge", "DELETE EDGE IN_REGION 3 -> 1 @0; MATCH (n:nation)-[:IN_REGION]->(r:region) RETURN count(*) AS n", "SELECT count(*) AS n FROM nation WHERE NOT (n_nationkey = 3 AND n_regionkey = 1)")
text_query("delete_edge_piped", "GO FROM 1 OVER KNOWS YIELD src(edge) AS s, dst(edge) AS d | DELETE EDGE KNOWS $-.s -> $-.d; MATCH (a:customer)-[:KNOWS]->(b:customer) WHERE a.c_custkey < 5 RETURN a.c_custkey AS a, b.c_custkey AS b", f"SELECT src AS a, dst AS b FROM {KNOWS} WHERE src < 5 AND src <> 1")
text_query("match_set", "MATCH (c:customer)-[:LIVES_IN]->(n:nation {n_name: 'CANADA'}) SET c.c_acctbal = 0.0; MATCH (c:customer) RETURN sum(c.c_acctbal) AS s", "SELECT sum(CASE WHEN n_name = 'CANADA' THEN 0 ELSE c_acctbal END) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey")
text_query("match_remove", "MATCH (s:supplier) WHERE s.s_acctbal < 0 REMOVE s.s_acctbal; MATCH (s:supplier) RETURN count(*) AS n, count(s.s_acctbal) AS m", "SELECT count(*) AS n, count(*) FILTER (s_acctbal >= 0) AS m FROM supplier")
text_query("match_delete", "MATCH (o:orders) WHERE o.o_orderstatus = 'P' DELETE o; MATCH (o:orders) RETURN o.o_orderstatus AS s, count(*) AS n", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
text_query("merge_node", "MERGE (r:region {r_name: 'ASIA'}) ON MATCH SET r.r_regionkey = 50 ON CREATE SET r.r_regionkey = 60; MERGE (r:region {r_name: 'NOWHERE'}) ON MATCH SET r.r_regionkey = 50 ON CREATE SET r.r_regionkey = 60; MATCH (r:region) RETURN r.r_name AS n, r.r_regionkey AS k", "SELECT r_name AS n, CASE WHEN r_name = 'ASIA' THEN 50 ELSE r_regionkey END::BIGINT AS k FROM region UNION ALL SELECT 'NOWHERE', 60")
text_query("create_pattern", "CREATE (a:city {id: 1, name: 'Ulm'})<-[:NEAR {km: 4}]-(b:city {id: 2, name: 'Senden'}); MATCH (b:city)-[e:NEAR]->(a:city) RETURN b.name AS b, e.km AS km, a.name AS a", "SELECT 'Senden' AS b, 4::BIGINT AS km, 'Ulm' AS a")
text_query("transaction_rollback", "BEGIN; DELETE VERTEX 1, 2, 3; ROLLBACK; MATCH (c:customer) RETURN count(*) AS n", "SELECT count(*) AS n FROM customer")
text_query("schema_alter", "ALTER TAG region ADD (note: STRING DEFAULT 'x'); ALTER TAG region CHANGE (r_name name: STRING); MATCH (r:region) RETURN r.name AS n, r.note AS t", "SELECT r_name AS n, 'x' AS t FROM region")
text_query("schema_describe", "DESC TAG nation", "SELECT * FROM (VALUES ('n_nationkey', 'bigint', 'YES', NULL, NULL), ('n_name', 'string', 'YES', NULL, NULL), ('n_regionkey', 'int', 'YES', NULL, NULL)) t(field, type, nullable, \"default\", comment)")
text_query("show_stats", "SHOW STATS", None)
text_query("explain_plan", "EXPLAIN MATCH (c:customer)-[:PLACED]->(o:orders) RETURN count(*) AS n", None)


# -- graph functions in query text
text_query(
    "graph_degree",
    "MATCH (c:customer) RETURN c.c_custkey AS k, degree(c) AS d, size(neighbors(c)) AS n, size(out_edges(c)) AS o, size(in_edges(c)) AS i",
    f"WITH k AS {KNOWS}, o AS (SELECT src AS v, count(*) AS o FROM k GROUP BY 1), i AS (SELECT dst AS v, count(*) AS i FROM k GROUP BY 1) SELECT c_custkey AS k, coalesce(o, 0) + coalesce(i, 0) AS d, coalesce(o, 0) + coalesce(i, 0) AS n, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM customer LEFT JOIN o ON o.v = c_custkey LEFT JOIN i ON i.v = c_custkey",
)
text_query(
    "graph_bfs",
    "MATCH (c:customer) WHERE c.c_custkey < 30 RETURN c.c_custkey AS k, size(bfs(c, 2)) AS n",
    f"WITH k AS {KNOWS}, e AS (SELECT src AS a, dst AS b FROM k UNION SELECT dst, src FROM k), one AS (SELECT c_custkey AS c, c_custkey AS v FROM customer WHERE c_custkey < 30 UNION SELECT a, b FROM e WHERE a < 30), two AS (SELECT c, v FROM one UNION SELECT c, b FROM one JOIN e ON a = v) SELECT c AS k, count(*) AS n FROM two WHERE c IN (SELECT c_custkey FROM customer) GROUP BY 1",
)
