"""Scalar functions by family, each over a whole table."""

from __future__ import annotations

from weftgraph.suite.base import text_query

text_query(
    "fn_strings",
    "MATCH (p:part) RETURN p.p_partkey AS k, length(p.p_name) AS a, upper(p.p_type) AS b, lower(p.p_type) AS c, trim('  x ') AS d, substring(p.p_name, 1, 3) AS e, concat(p.p_brand, '!') AS f, replace(p.p_brand, 'Brand', 'B') AS g, contains(p.p_name, '1') AS h, starts_with(p.p_name, 'P') AS i, ends_with(p.p_name, '7') AS j, split(p.p_brand, '#') AS l, lpad(p.p_type, 12, '.') AS m, rpad(p.p_type, 3, '.') AS n, concat_ws('-', p.p_brand, p.p_type) AS o, strcasecmp(p.p_type, 'medium') AS q, levenshtein(p.p_brand, 'Brand#55') AS r, split_part(p.p_brand, '#', 2) AS s, repeat('ab', 3) AS t, position(p.p_brand, '#') AS u, left(p.p_name, 2) AS v, right(p.p_name, 2) AS w, insert(p.p_brand, 0, 5, 'X') AS x, translate(p.p_brand, 'Bd', 'bD') AS y, format('{0}:{1}', p.p_size, p.p_type) AS z, replace(p.p_brand, '#') AS aa, reverse(p.p_type) AS ab",
    "SELECT p_partkey AS k, length(p_name) AS a, upper(p_type) AS b, lower(p_type) AS c, 'x' AS d, substring(p_name, 2, 3) AS e, p_brand || '!' AS f, replace(p_brand, 'Brand', 'B') AS g, contains(p_name, '1') AS h, starts_with(p_name, 'P') AS i, ends_with(p_name, '7') AS j, string_split(p_brand, '#') AS l, lpad(p_type, 12, '.') AS m, rpad(p_type, 3, '.') AS n, p_brand || '-' || p_type AS o, CASE WHEN lower(p_type) < 'medium' THEN -1 WHEN lower(p_type) > 'medium' THEN 1 ELSE 0 END AS q, levenshtein(p_brand, 'Brand#55') AS r, split_part(p_brand, '#', 2) AS s, 'ababab' AS t, instr(p_brand, '#') AS u, left(p_name, 2) AS v, right(p_name, 2) AS w, 'X' || substring(p_brand, 6) AS x, translate(p_brand, 'Bd', 'bD') AS y, p_size || ':' || p_type AS z, replace(p_brand, '#', '') AS aa, reverse(p_type) AS ab FROM part",
)
text_query("fn_initcap", "RETURN initcap('hello big WORLD') AS a, string_split('a,b', ',') AS b", "SELECT 'Hello Big World' AS a, ['a', 'b'] AS b")
text_query(
    "fn_math",
    "MATCH (c:customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, sqrt(abs(c.c_acctbal)) AS b, pow(c.c_nationkey, 2) AS c, round(log(2, c.c_custkey + 1), 9) AS d, round(log10(c.c_custkey + 1), 9) AS e, round(sin(c.c_acctbal), 7) AS f, round(cos(c.c_acctbal), 7) AS g, round(tan(c.c_custkey), 5) AS h, round(c.c_acctbal) AS i, ceil(c.c_acctbal) AS j, floor(c.c_acctbal) AS l, round(atan(c.c_acctbal), 9) AS m, round(cbrt(c.c_custkey), 9) AS n, round(hypot(c.c_custkey, 3), 9) AS o, sign(c.c_acctbal) AS p, round(e(), 9) AS q, round(pi(), 9) AS r, exp2(c.c_nationkey) AS s, round(log2(c.c_custkey + 1), 9) AS t, round(radians(c.c_custkey), 9) AS u, bit_and(c.c_custkey, 12) AS v, bit_or(c.c_custkey, 3) AS w, bit_xor(c.c_custkey, 5) AS x, round(atan2(c.c_acctbal, 3), 9) AS y, round(degrees(c.c_nationkey), 7) AS z, gcd(c.c_custkey, 84) AS ga, lcm(c.c_custkey, 6) AS lc",
    "SELECT c_custkey AS k, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS b, pow(c_nationkey, 2) AS c, round(log2(c_custkey + 1), 9) AS d, round(log10(c_custkey + 1), 9) AS e, round(sin(c_acctbal), 7) AS f, round(cos(c_acctbal), 7) AS g, round(tan(c_custkey), 5) AS h, round(c_acctbal) AS i, ceil(c_acctbal) AS j, floor(c_acctbal) AS l, round(atan(c_acctbal), 9) AS m, round(cbrt(c_custkey), 9) AS n, round(sqrt(c_custkey * c_custkey + 9), 9) AS o, sign(c_acctbal)::DOUBLE AS p, round(exp(1), 9) AS q, round(pi(), 9) AS r, pow(2, c_nationkey) AS s, round(log2(c_custkey + 1), 9) AS t, round(radians(c_custkey), 9) AS u, c_custkey & 12 AS v, c_custkey | 3 AS w, xor(c_custkey, 5) AS x, round(atan2(c_acctbal, 3), 9) AS y, round(degrees(c_nationkey), 7) AS z, gcd(c_custkey, 84) AS ga, lcm(c_custkey, 6) AS lc FROM customer",
)
text_query("fn_math_hyperbolic", "RETURN round(asin(0.5), 9) AS a, round(acos(0.5), 9) AS b, round(sinh(1.0), 9) AS c, round(cosh(1.0), 9) AS d, round(tanh(1.0), 9) AS e", "SELECT round(asin(0.5), 9) AS a, round(acos(0.5), 9) AS b, round(sinh(1.0), 9) AS c, round(cosh(1.0), 9) AS d, round(tanh(1.0), 9) AS e")
text_query(
    "fn_dates",
    "MATCH (o:orders) RETURN o.o_orderkey AS k, year(o.o_orderdate) AS y, month(o.o_orderdate) AS m, day(o.o_orderdate) AS d, hour(o.o_orderdate) AS h, minute(o.o_orderdate) AS mi, second(o.o_orderdate) AS s, date_diff(o.o_orderdate, date('2000-01-01')) AS dd, to_char(o.o_orderdate, '%Y/%m/%d') AS c, to_string(last_day(o.o_orderdate)) AS l, to_string(date_add(date('2020-01-30'), 3)) AS da, to_string(date_sub(date('2020-01-30'), 30)) AS ds, to_char(date_trunc(o.o_orderdate, 'month'), '%Y-%m-%d') AS t",
    "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, second(o_orderdate) AS s, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS dd, strftime(o_orderdate, '%Y/%m/%d') AS c, last_day(o_orderdate)::VARCHAR AS l, '2020-02-02' AS da, '2019-12-31' AS ds, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t FROM orders",
)
text_query("fn_date_parsing", "RETURN to_string(to_date('2020/03/04')) AS a, to_string(to_date('04-03-2020')) AS b, to_string(to_date('20200304')) AS c, time('01:02:03.5') AS t, timestamp(datetime('2020-01-01 00:00:01')) AS ts, generate_series(1, 5, 2) AS g, generate_series(5, 1) AS e, generate_series(5, 1, -2) AS n", "SELECT '2020-03-04' AS a, '2020-03-04' AS b, '2020-03-04' AS c, 3723500000::BIGINT AS t, 1577836801000::BIGINT AS ts, [1, 3, 5] AS g, []::INTEGER[] AS e, [5, 3, 1] AS n")
text_query("fn_regex", "MATCH (p:part) RETURN p.p_partkey AS k, regex_match(p.p_brand, '#[12]') AS a, regex_replace(p.p_brand, '[0-9]', 'n') AS b, regex_find(p.p_brand, '[0-9]+') AS c", "SELECT p_partkey AS k, regexp_matches(p_brand, '#[12]') AS a, regexp_replace(p_brand, '[0-9]', 'n', 'g') AS b, regexp_extract(p_brand, '[0-9]+') AS c FROM part")
text_query("fn_conversion", "MATCH (c:customer) RETURN c.c_custkey AS k, to_string(c.c_custkey) AS a, to_int(to_string(c.c_custkey)) AS b, to_float('1.5') AS c, to_bool('true') AS d, to_int('x') AS e", "SELECT c_custkey AS k, c_custkey::VARCHAR AS a, c_custkey AS b, 1.5::DOUBLE AS c, true AS d, NULL::BIGINT AS e FROM customer")
text_query(
    "fn_containers",
    "RETURN head([3,1,2]) AS a, last([3,1,2]) AS b, tail([3,1,2]) AS c, size([3,1,2]) AS d, range(1, 4) AS e, reverse([3,1,2]) AS f, toset([1,1,2]) AS g, list_contains([1,2], 2) AS h, list_append([1], 2) AS i, list_prepend([1], 2) AS j, list_filter([1,2,3], [true,false,true]) AS l, list_transform([1,2], [9, null]) AS m, list_concat([1], [2,3]) AS n, list_sort([3,1,2]) AS o, list_slice([1,2,3,4], 1, -1) AS p, list_to_string([1,2], '-') AS q, list_distinct([2,1,2]) AS r, list_unique([2,1,2]) AS s, list_extract([1,2,3], -1) AS t",
    "SELECT 3 AS a, 2 AS b, [1,2] AS c, 3 AS d, [1,2,3,4] AS e, [2,1,3] AS f, [1,2] AS g, true AS h, [1,2] AS i, [2,1] AS j, [1,3] AS l, [9,2] AS m, [1,2,3] AS n, [1,2,3] AS o, [2,3] AS p, '1-2' AS q, [2,1] AS r, [2,1] AS s, 3 AS t",
)
text_query("fn_utility", "MATCH (c:customer) RETURN c.c_custkey AS k, coalesce(null, c.c_name) AS a, nullif(c.c_nationkey, 3) AS b, greatest(c.c_custkey, 50) AS c, least(c.c_custkey, 50) AS d, ifnull(nullif(c.c_nationkey, 3), -1) AS e", "SELECT c_custkey AS k, c_name AS a, nullif(c_nationkey, 3) AS b, greatest(c_custkey, 50) AS c, least(c_custkey, 50) AS d, coalesce(nullif(c_nationkey, 3), -1) AS e FROM customer")
text_query("fn_json", "MATCH (e:event) RETURN e.event_id AS k, json_extract(e.props, 'k') AS a, json_build_object('u', e.user_id) AS b, json_object_keys(e.props) AS d, json_typeof(e.props) AS t, json_build_array(1, 'x', null) AS r, json_strip_nulls('{\"a\":1,\"b\":null}') AS s", "SELECT event_id AS k, props ->> '$.k' AS a, '{\"u\":' || user_id || '}' AS b, json_keys(props) AS d, 'object' AS t, '[1,\"x\",null]' AS r, '{\"a\":\"1\"}' AS s FROM events")
text_query("fn_list_statistics", "RETURN round(corr([1,2,3,4], [2,4,6,9]), 9) AS a, round(covar_pop([1,2,3,4], [2,4,6,9]), 9) AS b, round(covar_samp([1,2,3,4], [2,4,6,9]), 9) AS c", "SELECT round(corr(x, y), 9) AS a, round(covar_pop(x, y), 9) AS b, round(covar_samp(x, y), 9) AS c FROM (VALUES (1, 2), (2, 4), (3, 6), (4, 9)) t(x, y)")
text_query("fn_random", "MATCH (c:customer) RETURN c.c_custkey AS k, rand() < 1.0 AS a, rand32(5, 9) >= 5 AS b, rand64(10) < 10 AS c, length(gen_random_uuid()) AS u", "SELECT c_custkey AS k, true AS a, true AS b, true AS c, 36 AS u FROM customer")
text_query("fn_session", "RETURN now() > 0 AS a, current_timestamp() > 0 AS b, age(current_date()) AS c, length(current_user()) > 0 AS d, length(version()) > 0 AS e, typeof(1) AS t, hash('x') = hash('x') AS h, current_database() AS g", "SELECT true AS a, true AS b, 0 AS c, true AS d, true AS e, 'int' AS t, true AS h, 'default' AS g")
text_query(
    "fn_vectors",
    "MATCH (e:embeddings) RETURN e.vec_id AS k, round(cosine_similarity(e.embedding, normalize(e.embedding)), 6) AS a, round(dot_product(e.embedding, e.embedding), 4) AS b, round(euclidean_distance(e.embedding, [x IN e.embedding | x + 1]), 4) AS c, round(manhattan_distance(e.embedding, [x IN e.embedding | x + 1]), 3) AS d, dimension(e.embedding) AS f, round(l2_norm(e.embedding), 4) AS g, nnz(e.embedding) AS h",
    "SELECT vec_id AS k, 1.0::DOUBLE AS a, round(list_dot_product(v, v), 4) AS b, 8.0::DOUBLE AS c, 64.0::DOUBLE AS d, len(v) AS f, round(sqrt(list_dot_product(v, v)), 4) AS g, len(list_filter(v, lambda x: x <> 0)) AS h FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
)
text_query(
    "fn_geography",
    "RETURN st_point(2, 1) AS a, round(st_distance(st_point(0, 0), st_point(1, 0)), 4) AS b, st_dwithin(st_point(0, 0), st_point(1, 0), 120) AS c, st_centroid('POLYGON((0 0,2 0,2 2,0 2,0 0))') AS d, st_isvalid('POINT(200 0)') AS e, st_covers('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POINT(1 1)') AS f, st_coveredby('POINT(3 1)', 'POLYGON((0 0,2 0,2 2,0 2,0 0))') AS g, st_intersects('LINESTRING(0 0,2 2)', 'POINT(1 1)') AS h, st_astext(st_geogfromtext('point( 1 2 )')) AS i, round(st_length('LINESTRING(0 0,1 0)'), 4) AS j, st_npoints('LINESTRING(0 0,1 0)') AS l, st_startpoint('LINESTRING(0 0,1 0)') AS m, st_endpoint('LINESTRING(0 0,1 0)') AS n, st_isclosed('LINESTRING(0 0,1 0)') AS o, st_geometrytype('LINESTRING(0 0,1 0)') AS p, st_contains('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POINT(0 0)') AS q, st_within('POINT(1 1)', 'POLYGON((0 0,2 0,2 2,0 2,0 0))') AS r, st_envelope('LINESTRING(0 0,1 3)') AS s, st_boundary('POLYGON((0 0,2 0,2 2,0 0))') AS t, st_crosses('LINESTRING(0 0,2 2)', 'LINESTRING(0 2,2 0)') AS u, st_touches('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POINT(2 1)') AS v, st_overlaps('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POLYGON((1 1,3 1,3 3,1 3,1 1))') AS w, st_equals('POINT(1 1)', 'POINT(1 1)') AS x, st_asgeojson('POINT(1 2)') AS y, st_geomfromgeojson('{\"type\":\"Point\",\"coordinates\":[1,2]}') AS z, st_npoints(st_buffer('POINT(0 0)', 10)) AS bu, st_isring('LINESTRING(0 0,1 0,0 0)') AS ri, round(st_perimeter('POLYGON((0 0,1 0,1 1,0 0))'), 3) AS pe, round(st_area('POLYGON((0 0,1 0,1 1,0 1,0 0))'), 2) AS ar",
    "SELECT 'POINT(2 1)' AS a, round(2 * 6371 * asin(sin(radians(0.5))), 4) AS b, true AS c, 'POINT(1 1)' AS d, false AS e, true AS f, false AS g, true AS h, 'POINT(1 2)' AS i, round(2 * 6371 * asin(sin(radians(0.5))), 4) AS j, 2 AS l, 'POINT(0 0)' AS m, 'POINT(1 0)' AS n, false AS o, 'LINESTRING' AS p, false AS q, true AS r, 'POLYGON((0 0,1 0,1 3,0 3,0 0))' AS s, 'LINESTRING(0 0,2 0,2 2,0 0)' AS t, true AS u, true AS v, true AS w, true AS x, '{\"type\":\"Point\",\"coordinates\":[1,2]}' AS y, 'POINT(1 2)' AS z, 17 AS bu, true AS ri, round(2 * 6371 * asin(sin(radians(0.5))) * 2 + 2 * 6371 * asin(sqrt(sin(radians(0.5))**2 + cos(radians(1)) * sin(radians(0.5))**2)), 3) AS pe, round(111.32 * 111.32 * cos(radians(0.4)), 2) AS ar",
)
