"""Graph functions in query text over the four people."""

import pytest


def one(people, text):
    return {r.n: r.v for r in people.query(f"MATCH (a:Person) RETURN a.name AS n, {text} AS v").collect()}


def test_values_of_a_vertex(people):
    assert one(people, "degree(a)") == {"Alice": 2, "Bob": 2, "Charlie": 3, "David": 1}
    assert one(people, "neighbors(a)") == {"Alice": [2, 3], "Bob": [1, 3], "Charlie": [1, 2, 4], "David": [3]}
    assert {k: [e.dst for e in v] for k, v in one(people, "out_edges(a)").items()} == {"Alice": [2, 3], "Bob": [3], "Charlie": [4], "David": []}
    assert {k: len(v) for k, v in one(people, "in_edges(a)").items()} == {"Alice": 0, "Bob": 1, "Charlie": 2, "David": 1}


def test_searches(people):
    assert one(people, "shortest_path(a, 4)") == {"Alice": 2, "Bob": 2, "Charlie": 1, "David": 0}
    assert one(people, "shortest_path(a, 99)") == dict.fromkeys(["Alice", "Bob", "Charlie", "David"], -1)
    assert one(people, "bfs(a, 1)") == {"Alice": [1, 2, 3], "Bob": [2, 1, 3], "Charlie": [3, 1, 2, 4], "David": [4, 3]}
    assert one(people, "variable_length_path(a, 4, 3)") == {"Alice": [[1, 2, 3, 4], [1, 3, 4]], "Bob": [[2, 3, 4]], "Charlie": [[3, 4]], "David": []}
    assert one(people, "variable_length_path(a, 4, 3, 3)")["Alice"] == [[1, 2, 3, 4]]


def test_whole_graph(people):
    assert set(one(people, "connected_components(a)").values()) == {1}
    assert one(people, "connected_components()")["Bob"] == [[1, 2, 3, 4]]
    scores = one(people, "pagerank(a)")
    assert sum(scores.values()) == pytest.approx(1) and max(scores, key=scores.get) == "David"
    assert one(people, "pagerank()")["Alice"][4] == pytest.approx(scores["David"])


def test_calls_in_conditions_and_aggregates(people):
    assert [r.n for r in people.query("MATCH (a:Person) RETURN a.name AS n ORDER BY degree(a) DESC, a.name LIMIT 2").collect()] == ["Charlie", "Alice"]
    assert people.query("MATCH (a:Person) RETURN max(degree(a)) AS m, count(*) AS c").collect()[0].m == 3
