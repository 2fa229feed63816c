"""Statements over the four-person graph, with answers worked out by hand."""

import pytest

from tests.conftest import rows
from weftgraph.lang.lexer import QueryError
from weftgraph.model import GraphSpace, Schema
from weftgraph.session import Session

CASES = [
    ("MATCH (a:Person)-[:KNOWS]->(b) WHERE a.age > 26 RETURN a.name AS a, b.name AS b", [("Alice", "Bob"), ("Alice", "Charlie"), ("Charlie", "David")]),
    ("MATCH (a:Person {name: 'Alice'})-[e:KNOWS*1..3]->(b:Person) RETURN b.name AS n, size(e) AS hops", [("Bob", 1), ("Charlie", 1), ("Charlie", 2), ("David", 2), ("David", 3)]),
    ("MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.age > 30 RETURN a.name AS a, count(b) AS n", [("Alice", 1), ("Bob", 1), ("Charlie", 0), ("David", 0)]),
    ("MATCH (a:Person) WHERE NOT EXISTS {MATCH (a)-[:KNOWS]->(x)} RETURN a.name AS n", [("David",)]),
    ("MATCH (a:Person) WHERE EXISTS {MATCH (a)-[:KNOWS]->(x:Person) WHERE x.age > a.age} OR a.name = 'David' RETURN a.name AS n", [("Alice",), ("Bob",), ("David",)]),
    ("MATCH (a:Person) WITH a.city AS city, count(*) AS n WHERE n > 1 RETURN city, n", [("NY", 2)]),
    ("MATCH (a:Person)-[e]-(b) WHERE id(a) = 3 RETURN id(b) AS b", [(1,), (2,), (4,)]),
    ("GO 2 STEPS FROM 1 OVER KNOWS YIELD dst AS d", [(3,), (4,)]),
    ("GO FROM 1 OVER KNOWS YIELD dst AS d | GO FROM $-.d OVER KNOWS YIELD $-.d AS mid, dst AS e", [(2, 3), (3, 4)]),
    ("FIND SHORTEST PATH FROM 1 TO 4 OVER KNOWS", [(1, 4, 2, [1, 3, 4])]),
    ("FIND SHORTEST PATH FROM 1 TO 4 OVER KNOWS WEIGHT w", [(1, 4, 3.0, [1, 2, 3, 4])]),
    ("FIND ALL PATH FROM 1 TO 4 OVER KNOWS UPTO 5 STEPS", [(1, 4, 2, [1, 3, 4]), (1, 4, 3, [1, 2, 3, 4])]),
    ("FIND SHORTEST PATH FROM 4 TO 1 OVER KNOWS UPTO 2 STEPS", []),
    ("UNWIND [1, 2, 2, null] AS x RETURN x", [(1,), (2,), (2,), (None,)]),
    ("YIELD 7 / 2 AS q, 'ab' =~ 'a%' AS l, 1 IN [1, null] AS i", [(3, True, True)]),
    ("MATCH (a:Person) RETURN sum(a.age) AS s, count(DISTINCT a.city) AS c", [(118, 2)]),
    ("MATCH (a:Person), (b:Person) WHERE a.id < b.id AND a.city = b.city RETURN a.name AS a, b.name AS b", [("Alice", "Charlie")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_answers(people, text, want):
    assert rows(people.query(text)) == sorted(want, key=repr)


def test_cycles_and_loops(spark):
    space = GraphSpace(spark).add_tag("N", spark.range(1, 4).withColumnRenamed("id", "k"), "k")
    space.add_edge("E", spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "s long, d long"), "s", "d", None, "N", "N")
    find = lambda flags: [r[0] for r in rows(space.query(f"FIND ALL PATH {flags} FROM 1 TO 3 OVER E UPTO 4 STEPS YIELD nodes AS n"))]
    assert find("") == [[1, 2, 3]]
    assert find("WITH LOOP") == [[1, 1, 2, 3], [1, 2, 3]]
    assert find("WITH CYCLE") == [[1, 2, 3]]  # 1-2-1-2-3 repeats the edge 1 -> 2


def test_parameters(people):
    assert rows(people.query("MATCH (a:Person) WHERE a.age > $low AND a.city IN $cities RETURN a.name AS n", low=26, cities=["NY"])) == [("Alice",), ("Charlie",)]


def test_changes_are_seen_by_later_statements(people):
    people.query("INSERT VERTEX Person(id, name, age) VALUES 5:(5, 'Eve', 40)")
    people.query("INSERT EDGE KNOWS(s, d, w) VALUES 5 -> 1:(5, 1, 2.0)")
    assert rows(people.query("MATCH (a:Person)-[:KNOWS]->(b) WHERE id(a) = 5 RETURN b.name AS n")) == [("Alice",)]
    people.query("UPDATE VERTEX 5 ON Person SET age = age + 1")
    people.query("MATCH (a:Person {name: 'Eve'}) SET a.city = 'X'")
    assert rows(people.query("FETCH PROP ON Person 5 YIELD Person.age AS a, Person.city AS c")) == [(41, "X")]
    people.query("DELETE VERTEX 5 WITH EDGE")
    assert people.query("MATCH (a:Person) RETURN count(*) AS n").first()[0] == 4
    assert people.edge("KNOWS").df.count() == 4


def test_insert_keeps_or_replaces(people):
    people.query("INSERT VERTEX IF NOT EXISTS Person(id, name) VALUES 1:(1, 'New')")
    assert people.query("FETCH PROP ON Person 1 YIELD Person.name AS n").first()[0] == "Alice"
    people.query("INSERT VERTEX Person(id, name) VALUES 1:(1, 'New')")
    assert tuple(people.query("FETCH PROP ON Person 1 YIELD Person.name AS n, Person.age AS a").first()) == ("New", None)


def test_merge_matches_or_creates(people):
    text = "MERGE (p:Person {name: 'Zed'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 2"
    people.query(text)
    assert people.query("MATCH (a:Person {name: 'Zed'}) RETURN a.age AS a").first()[0] == 1
    people.query(text)
    assert people.query("MATCH (a:Person {name: 'Zed'}) RETURN a.age AS a").first()[0] == 2


def test_transactions(people):
    people.query("BEGIN; DELETE VERTEX 1; ROLLBACK")
    assert people.tag("Person").df.count() == 4
    people.query("BEGIN; DELETE VERTEX 1; COMMIT")
    assert people.tag("Person").df.count() == 3
    with pytest.raises(QueryError):
        people.query("ROLLBACK")


def test_schema_is_declared_and_checked(spark):
    s = Session(spark=spark)
    s.query("CREATE SPACE g(vid_type=FIXED_STRING(32)); USE g")
    s.query("CREATE TAG p(name: STRING NOT NULL, age: INT DEFAULT 7)")
    s.query("INSERT VERTEX p(name) VALUES 'a':('x')")
    assert tuple(s.query("MATCH (v:p) RETURN id(v) AS i, v.name AS n, v.age AS a").first()) == ("a", "x", 7)
    with pytest.raises(QueryError):
        s.query("INSERT VERTEX p(age) VALUES 'b':(1)")
    with pytest.raises(QueryError):
        s.query("CREATE TAG p(x: INT)")
    s.query("CREATE TAG IF NOT EXISTS p(x: INT); DROP TAG p")
    with pytest.raises(QueryError):
        s.query("MATCH (v:p) RETURN v")


def test_ttl_hides_what_has_run_out(spark):
    df = spark.sql("SELECT 1L AS k, unix_timestamp() AS seen UNION ALL SELECT 2L, 0L UNION ALL SELECT 3L, CAST(NULL AS BIGINT)")
    space = GraphSpace(spark).add_tag("t", df, "k", Schema(ttl_column="seen", ttl_seconds=100))
    assert rows(space.query("MATCH (v:t) RETURN v.k AS k")) == [(1,), (3,)]


def test_unknown_names(people):
    for text in ("MATCH (a:Nobody) RETURN a", "GO FROM 1 OVER nothing", "MATCH (a:Person) RETURN a.nope", "RETURN nofunction(1)", "MATCH (a:Person) RETURN z"):
        with pytest.raises(QueryError):
            people.query(text)


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "id % 5 AS x", "id AS unused").write.parquet(str(tmp_path / "t"))
    space = GraphSpace(spark).add_tag("t", spark.read.parquet(str(tmp_path / "t")), "k")
    plan = space.query("EXPLAIN MATCH (v:t) WHERE v.x > 3 RETURN v.k AS k").first()[0]
    assert "GreaterThan(x,3)" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
