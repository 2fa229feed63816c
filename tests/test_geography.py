"""Geography over many shapes at once, against plain arithmetic."""

import math
import random

from pyspark.sql import functions as F

from weftgraph.functions import geo


def wkt(rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def run(spark, rows, columns, **made):
    df = spark.createDataFrame(rows, columns)
    return df.select(*[c.alias(k) for k, c in made.items()]).collect()


def test_areas_with_holes(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        x, y, w, h = rng.randint(-50, 50), rng.randint(-50, 50), rng.randint(4, 9), rng.randint(4, 9)
        hole = box(x + 1, y + 1, rng.randint(1, w - 2), rng.randint(1, h - 2))
        if rng.random() < 0.5:
            hole.reverse()
        rows.append((wkt([box(x, y, w, h)]), wkt([box(x, y, w, h), hole]), w * h, (hole[2][0] - hole[0][0]) * (hole[2][1] - hole[0][1])))
    g, k = F.col("g"), F.col("k")
    for r in run(spark, rows, "g string, k string, area long, hole long", g=geo.st_area(g), k=geo.st_area(k), area=F.col("area"), hole=F.col("hole"), pg=geo.st_perimeter(g), pk=geo.st_perimeter(k)):
        assert math.isclose(r.k / r.g, 1 - abs(r.hole) / r.area, rel_tol=1e-9) and r.pk > r.pg
    two = "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0),(0.5 0.5,1 0.5,1 1,0.5 1,0.5 0.5)),((10 0,12 0,12 2,10 2,10 0)))"
    one = "POLYGON((0 0,2 0,2 2,0 2,0 0))"
    (r,) = run(spark, [(two, one)], "a string, b string", ratio=geo.st_area(F.col("a")) / geo.st_area(F.col("b")), line=geo.st_area(F.lit("LINESTRING(0 0,1 0,1 1,0 0)")))
    assert math.isclose(r.ratio, 2 - 0.25 / 4, rel_tol=1e-9) and r.line == 0


def test_relations_of_shapes(spark):
    ell = "POLYGON((0 0,10 0,10 1,1 1,1 10,0 10,0 0))"
    other = "POLYGON((2 2,9 2,9 9,2 9,2 2))"
    ring = "POLYGON((0 0,10 0,10 10,0 10,0 0),(1 1,9 1,9 9,1 9,1 1))"
    rows = [(ell, other, False), (ell, "LINESTRING(0.5 -1,0.5 0.5)", True), (other, "POINT(3 3)", True), (ring, "POINT(5 5)", False), (ring, "POLYGON((2 2,3 2,3 3,2 2))", False), (other, "POLYGON((3 3,4 3,4 4,3 3))", True), ("LINESTRING(0 0,4 4)", "LINESTRING(0 1,3 4)", False), ("LINESTRING(0 0,4 4)", "LINESTRING(2 2,9 2)", True), ("POINT(1 1)", "POINT(1 1)", True), ("POINT(1 1)", "POINT(1 2)", False), ("MULTIPOINT(1 1,5 5)", "LINESTRING(2 2,3 3)", False)]
    a, b = F.col("a"), F.col("b")
    for r in run(spark, rows, "a string, b string, want boolean", got=geo.st_intersects(a, b), back=geo.st_intersects(b, a), want=F.col("want"), a=a, b=b, far=geo.st_distance(a, b)):
        assert r.got == r.back == r.want and (r.far == 0) == r.want, r


def test_distance_to_edges(spark):
    a, b = F.col("a"), F.col("b")
    rows = [("POINT(5 1)", "LINESTRING(0 0,10 0)", 1.0), ("LINESTRING(0 0,10 0)", "POINT(5 -1)", 1.0), ("POINT(0 2)", "POLYGON((-5 0,5 0,5 1,-5 1,-5 0))", 1.0)]
    for r in run(spark, rows, "a string, b string, degrees double", far=geo.st_distance(a, b), degrees=F.col("degrees")):
        assert math.isclose(r.far, r.degrees * math.pi * 6371 / 180, rel_tol=1e-3)


def test_rings_equality_and_borders(spark):
    g, h = F.col("g"), F.col("h")
    rows = [
        ("LINESTRING(0 0,2 0,2 2,0 0)", "LINESTRING(0 0,2 2,2 0,0 0)", True, True),
        ("LINESTRING(0 0,2 2,2 0,0 2,0 0)", "LINESTRING(0 0,2 0,2 2,0 0)", False, False),
        ("LINESTRING(0 0,1 1)", "LINESTRING(1 1,0 0)", False, True),
        ("POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((2 2,2 0,0 0,0 2,2 2))", True, True),
        ("MULTIPOINT(0 0,1 1)", "MULTIPOINT(1 1,0 0)", False, True),
    ]
    for r in run(spark, rows, "g string, h string, ring boolean, same boolean", ring=geo.st_isring(g), same=geo.st_equals(g, h), want=F.col("ring"), equal=F.col("same"), g=g):
        assert (r.ring, r.same) == (r.want, r.equal), r
    (r,) = run(spark, [(wkt([box(0, 0, 4, 4), box(1, 1, 1, 1)]), wkt([box(0, 0, 1, 1)]))], "g string, h string", g=geo.st_boundary(g), h=geo.st_boundary(h))
    assert r.g == "MULTILINESTRING((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))" and r.h == "LINESTRING(0 0,1 0,1 1,0 1,0 0)"
