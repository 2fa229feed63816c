import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.operators import algorithms, relational
from weftgraph.operators.search import Searcher, parse
from weftgraph.sources import files


def test_set_operations_keep_or_drop_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long")
    b = spark.createDataFrame([(1,), (None,)], "y long")
    assert rows(relational.intersect(a, b)) == [(1,), (None,)]
    assert rows(relational.intersect(a, b, multiset=True)) == [(1,), (1,), (None,)]
    assert rows(relational.minus(a, b, multiset=True)) == [(2,)]
    with pytest.raises(ValueError):
        relational.union(a, a.withColumn("z", F.lit(1)))


def test_join_renames_clashes(spark):
    a = spark.createDataFrame([(1, "l")], "k long, v string")
    assert relational.join(a, a, [("k", "k")]).columns == ["k", "v", "k_1", "v_1"]


def test_rollup_apply_gives_empty_lists(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, 5), (1, 3)], "k long, v long")
    assert rows(relational.rollup_apply(a, b, [("k", "k")], "v", "vs")) == [(1, [3, 5]), (2, [])]


def test_sample_is_exact(spark):
    df = spark.range(100)
    assert relational.sample(df, 7).count() == 7
    assert relational.sample(df, 1000).count() == 100
    assert [r[0] for r in relational.sample(df, 5, "system", key="id").collect()] == [0, 20, 40, 60, 80]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "src long, dst long")
    got = dict(rows(algorithms.connected_components(edges)))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    scores = dict(rows(algorithms.pagerank(edges, tolerance=1e-9)))
    assert sum(scores.values()) == pytest.approx(1.0) and max(scores, key=scores.get) == 1 and scores[4] == pytest.approx(0.15 / 4)


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert algorithms.connected_components(edges).count() == 0
    assert algorithms.pagerank(edges).count() == 0


def test_search_text_is_parsed():
    q = parse('+must maybe -never "a phrase" pre* wi?d fuz~2 n:[1 TO 5]')
    assert [n.text for n in q.must] == ["must"] and [n.text for n in q.must_not] == ["never"]
    assert [n.kind for n in q.should] == ["term", "phrase", "prefix", "wildcard", "fuzzy", "range"] and q.should[4].distance == 2


def test_search_ranks_and_marks(spark):
    df = spark.createDataFrame([(1, "graph graph database"), (2, "a graph"), (3, "nothing here"), (4, None)], "k long, t string")
    run = Searcher(df, ["t"], "graph")
    got = run.run().orderBy(F.desc("__score")).select("k", run.highlight(F.col("t")).alias("h")).collect()
    assert [r.k for r in got] == [1, 2] or [r.k for r in got] == [2, 1]
    assert "<em>graph</em>" in got[0].h


def test_files_round_trip(spark, people, tmp_path):
    path = str(tmp_path)
    files.dump(people, path + "/d")
    back = files.restore(spark, path + "/d")
    assert rows(back.query("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b")) == rows(people.query("MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b"))
    df = spark.createDataFrame([(1, 'a"b,c\nd'), (2, None)], "k long, v string")
    files.export_csv(df, path + "/c")
    assert rows(files.import_csv(spark, path + "/c", df.schema)) == rows(df)
    files.export_json(df, path + "/j")
    assert rows(files.import_json(spark, path + "/j", df.schema)) == rows(df)


@pytest.mark.parametrize("kind", ["table", "vertical", "csv", "json", "html"])
def test_output_formats(spark, kind):
    text = files.render(spark.createDataFrame([(1, "<x>"), (2, None)], "k long, v string"), kind)
    assert "2" in text and ("&lt;x&gt;" in text if kind == "html" else "<x>" in text)


def test_not_in_is_three_valued(people):
    """No row when the side holds a null; none for a null operand unless the side is empty."""
    def names(text):
        return sorted(r.n for r in people.query(text).collect())

    side = "IN { MATCH (b:Person) WHERE %s RETURN b.city }"
    assert names("MATCH (a:Person) WHERE a.city NOT " + side % "b.age > 20" + " RETURN a.name AS n") == []
    assert names("MATCH (a:Person) WHERE a.city NOT " + side % "b.age = 25" + " RETURN a.name AS n") == ["Alice", "Charlie"]
    assert names("MATCH (a:Person) WHERE a.city NOT " + side % "b.age > 99" + " RETURN a.name AS n") == ["Alice", "Bob", "Charlie", "David"]
    assert names("MATCH (a:Person) WHERE a.age = 28 OR a.city NOT " + side % "b.age = 25" + " RETURN a.name AS n") == ["Alice", "Charlie", "David"]


def test_group_concat_uses_all_sort_keys(people):
    row = people.query("MATCH (a:Person) RETURN group_concat(a.name, '-') WITHIN GROUP (ORDER BY a.city DESC, a.age) AS g").collect()
    assert row[0].g == "Alice-Charlie-Bob-David"


def test_long_chains_have_no_cap(spark):
    from weftgraph.operators import paths

    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(70)], "here long, there long, w double")
    ends = lambda i: spark.createDataFrame([(i,)], "vid long")
    (row,) = paths.shortest_paths(chain, ends(0), ends(70)).collect()
    assert row.length == 70 and row.nodes == list(range(71))
    assert paths.shortest_paths(chain, ends(0), ends(4), 3).count() == 0
    assert paths.shortest_paths(chain, ends(70), ends(0)).count() == 0


def test_shortest_paths_match_brute_force(spark):
    import random
    from collections import deque

    from weftgraph.operators import paths

    rng = random.Random(5)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(60)})
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want = {}
    for s in range(5):
        best, queue = {s: [s]}, deque([s])
        level = [s]
        while level:
            nxt = {}
            for v in level:
                for w in out.get(v, []):
                    if w not in best:
                        walk = best[v] + [w]
                        nxt[w] = min(nxt.get(w, walk), walk)
            best |= nxt
            level = sorted(nxt)
        want |= {(s, t): best[t] for t in range(10, 16) if t in best}
    df = spark.createDataFrame(pairs, "here long, there long")
    got = paths.shortest_paths(df, spark.createDataFrame([(i,) for i in range(5)], "v long"), spark.createDataFrame([(i,) for i in range(10, 16)], "v long"))
    assert {(r.src, r.dst): r.nodes for r in got.collect()} == want
