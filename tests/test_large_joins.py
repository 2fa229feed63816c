"""Joins whose pairs or broadcasts would outgrow their input."""

from tests.conftest import rows
from weftgraph.operators import algorithms, relational


def test_a_join_is_counted_without_its_pairs(spark):
    """4 * 10^12 pairs of one key: none is made. Null keys are equal only where asked; no match counts 0."""
    many = spark.range(2_000_000).selectExpr("7 AS k")
    assert relational.count_join(many, many, [("k", "k")]).collect()[0].n == 4 * 10**12
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "y")], "k long, t string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "x"), (None, "x"), (None, None)], "l int, u string")
    for keys in ([("k", "l")], [("k", "l"), ("t", "u")], []):
        for null_safe in (False, True):
            assert relational.count_join(a, b, keys, null_safe).collect()[0].n == relational.join(a, b, keys, null_safe=null_safe).count(), (keys, null_safe)
    assert rows(relational.count_join(a, b.where("l > 9"), [("k", "l")])) == [(0,)]


def test_the_null_safe_query_makes_no_pairs(spark):
    from weftgraph.suite.registry import QUERIES

    plan = QUERIES["join_null_safe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join")
    assert plan.count("Aggregate", joined) == 2, plan


def test_components_broadcast_nothing(spark, monkeypatch):
    """Labels by vertex are as many as the vertices: a broadcast would send them through the driver each round."""
    plans = []

    def settle(df, label="table", *rest):
        if label == "labels":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *rest)

    real = algorithms.settle
    monkeypatch.setattr(algorithms, "settle", settle)
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 4), (6, 6)], "src long, dst long")
    assert rows(algorithms.connected_components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
