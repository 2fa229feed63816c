"""Geography functions over WKT text in degrees (longitude latitude).

A geometry is a WKT string, parsed by built-in expressions into parts: the rings of polygons (the first of each polygon is its
shell, others are holes), lines, or points. Distances are great-circle kilometres on a sphere of radius 6371, to the nearest
place of an edge in the plane that touches the sphere there; areas use planar degrees scaled to square kilometres at the shape's
mean latitude. Predicates are planar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.scalar import scalar

RADIUS_KM = 6371.0
KM_A_DEGREE = 111.32
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def coords(g: Column) -> Column:
    """All coordinate pairs of a geometry, in order."""
    pairs = F.regexp_extract_all(g, F.lit(rf"({NUMBER}\s+{NUMBER})"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column) -> Column:
    """Coordinate arrays of the innermost brackets of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([^()]*\d[^()]*)"), F.lit(1)), coords)


def parts(g: Column) -> Column:
    """Rings, lines or points, each an array of coordinates."""
    return _parts(g)


def polygons(g: Column) -> Column:
    """The polygons of an area, each an array of rings."""
    return F.transform(F.split(g, r"\)\s*\)\s*,\s*\(\s*\("), _parts)


def is_area(g: Column) -> Column:
    return st_geometrytype(g).isin("POLYGON", "MULTIPOLYGON")


def is_points(g: Column) -> Column:
    return st_geometrytype(g).isin("POINT", "MULTIPOINT")


def x_of(g: Column) -> Column:
    return F.get(coords(g), F.lit(0))["x"]


def y_of(g: Column) -> Column:
    return F.get(coords(g), F.lit(0))["y"]


def number(x: Column) -> Column:
    """A coordinate without a trailing .0."""
    return F.regexp_replace(x.cast("decimal(18,10)").cast("string"), r"\.?0+$", "")


def haversine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    p, q = F.radians(ay), F.radians(by)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(bx - ax) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * RADIUS_KM)


def bounds(g: Column) -> tuple[Column, Column, Column, Column]:
    c = coords(g)
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def _edges(c: Column) -> Column:
    """Neighbouring pairs of an array of coordinates."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(g: Column) -> Column:
    """All edges of lines and rings; points have none."""
    every = F.flatten(F.transform(parts(g), _edges))
    return F.when(is_points(g), F.slice(every, 1, 0)).otherwise(every)


def side(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def beside(p: Column, e: Column) -> Column:
    """A point on the line of an edge lies between its ends."""
    return p["x"].between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & p["y"].between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))


def meet(e: Column, f: Column) -> Column:
    """Two edges share a point."""
    s1, s2 = side(e["a"], e["b"], f["a"]), side(e["a"], e["b"], f["b"])
    s3, s4 = side(f["a"], f["b"], e["a"]), side(f["a"], f["b"], e["b"])
    proper = (s1 * s2 < 0) & (s3 * s4 < 0)
    return proper | ((s1 == 0) & beside(f["a"], e)) | ((s2 == 0) & beside(f["b"], e)) | ((s3 == 0) & beside(e["a"], f)) | ((s4 == 0) & beside(e["b"], f))


def on_or_in(p: Column, g: Column) -> Column:
    return (is_area(g) & inside(p["x"], p["y"], g)) | on_edge(p["x"], p["y"], g) | F.exists(coords(g), lambda q: (q["x"] == p["x"]) & (q["y"] == p["y"]))


def to_edge(p: Column, e: Column) -> Column:
    """Kilometres from a point to the nearest place of an edge, found in the plane that touches the sphere at the point."""
    k = F.cos(F.radians(p["y"]))
    dx, dy = (e["b"]["x"] - e["a"]["x"]) * k, e["b"]["y"] - e["a"]["y"]
    px, py = (p["x"] - e["a"]["x"]) * k, p["y"] - e["a"]["y"]
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return haversine(p["x"], p["y"], e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"]))


def inside(px: Column, py: Column, g: Column) -> Column:
    """Ray casting: an odd number of edges to the right of the point."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    return F.size(F.filter(edges(g), crosses)) % 2 == 1


def on_edge(px: Column, py: Column, g: Column) -> Column:
    def touches(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = F.abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) < 1e-12
        return flat & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))

    return F.exists(edges(g), touches)


@scalar("st_point")
def st_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), number(x.cast("double")), F.lit(" "), number(y.cast("double")), F.lit(")"))


@scalar("st_geogfromtext")
def st_geogfromtext(wkt: Column) -> Column:
    return F.when(st_isvalid(wkt), F.upper(F.regexp_replace(F.trim(wkt), r"\s*([(),])\s*", "$1")))


@scalar("st_astext")
def st_astext(g: Column) -> Column:
    return g


@scalar("st_isvalid")
def st_isvalid(g: Column) -> Column:
    c = coords(g)
    shape = F.regexp_like(g, F.lit(r"(?i)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*\(.*\)\s*$"))
    ranged = F.forall(c, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)) & (F.size(c) > 0)
    kind = st_geometrytype(g)
    enough = F.when(kind == "LINESTRING", F.size(c) >= 2).when(kind == "POLYGON", (F.size(c) >= 4) & st_isclosed(g)).otherwise(F.lit(True))
    return shape & ranged & enough


@scalar("st_geometrytype")
def st_geometrytype(g: Column) -> Column:
    return F.upper(F.regexp_extract(g, r"^\s*([A-Za-z]+)", 1))


@scalar("st_centroid")
def st_centroid(g: Column) -> Column:
    """The mean of the vertices, a ring's closing vertex left out."""
    c = coords(g)
    c = F.when(st_geometrytype(g) == "POLYGON", F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))).otherwise(c)
    n = F.size(c).cast("double")
    mean = lambda k: F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p[k]) / n
    return st_point(mean("x"), mean("y"))


@scalar("st_distance")
def st_distance(a: Column, b: Column) -> Column:
    """Kilometres between the nearest places of two shapes; 0 where they share a point."""
    pair = F.struct(coords(a).alias("ca"), coords(b).alias("cb"), edges(a).alias("ea"), edges(b).alias("eb"))

    def nearest(s: Column) -> Column:
        points = F.flatten(F.transform(s["ca"], lambda p: F.transform(s["cb"], lambda q: haversine(p["x"], p["y"], q["x"], q["y"]))))
        one = F.flatten(F.transform(s["ca"], lambda p: F.transform(s["eb"], lambda e: to_edge(p, e))))
        two = F.flatten(F.transform(s["cb"], lambda p: F.transform(s["ea"], lambda e: to_edge(p, e))))
        return F.array_min(F.concat(points, one, two))

    return F.when(~(is_points(a) & is_points(b)) & st_intersects(a, b), F.lit(0.0)).otherwise(let(pair, nearest))


@scalar("st_dwithin")
def st_dwithin(a: Column, b: Column, km: Column) -> Column:
    return st_distance(a, b) <= km


@scalar("st_intersects")
def st_intersects(a: Column, b: Column) -> Column:
    """The shapes share a point: their boxes meet, and then some edges do or one has a point of the other."""
    ax, ay, aX, aY = bounds(a)
    bx, by, bX, bY = bounds(b)
    boxes = (ax <= bX) & (bx <= aX) & (ay <= bY) & (by <= aY)
    pair = F.struct(edges(a).alias("a"), edges(b).alias("b"))
    crossing = let(pair, lambda s: F.exists(s["a"], lambda e: F.exists(s["b"], lambda f: meet(e, f))))
    return boxes & (crossing | F.exists(coords(a), lambda p: on_or_in(p, b)) | F.exists(coords(b), lambda p: on_or_in(p, a)))


@scalar("st_covers")
def st_covers(a: Column, b: Column) -> Column:
    return F.forall(coords(b), lambda p: inside(p["x"], p["y"], a) | on_edge(p["x"], p["y"], a) | F.exists(coords(a), lambda q: (q["x"] == p["x"]) & (q["y"] == p["y"])))


@scalar("st_coveredby")
def st_coveredby(a: Column, b: Column) -> Column:
    return st_covers(b, a)


@scalar("st_contains")
def st_contains(a: Column, b: Column) -> Column:
    return F.forall(coords(b), lambda p: inside(p["x"], p["y"], a) & ~on_edge(p["x"], p["y"], a))


@scalar("st_within")
def st_within(a: Column, b: Column) -> Column:
    return st_contains(b, a)


@scalar("st_touches")
def st_touches(a: Column, b: Column) -> Column:
    edge = F.exists(coords(b), lambda p: on_edge(p["x"], p["y"], a)) | F.exists(coords(a), lambda p: on_edge(p["x"], p["y"], b))
    deep = F.exists(coords(b), lambda p: inside(p["x"], p["y"], a) & ~on_edge(p["x"], p["y"], a)) | F.exists(coords(a), lambda p: inside(p["x"], p["y"], b) & ~on_edge(p["x"], p["y"], b))
    return edge & ~deep


def _cross(a: Column, b: Column) -> Column:
    """Some edge of one properly crosses some edge of the other."""

    def through(e: Column, f: Column) -> Column:
        return (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)

    pair = F.struct(edges(a).alias("a"), edges(b).alias("b"))
    return let(pair, lambda s: F.exists(s["a"], lambda e: F.exists(s["b"], lambda f: through(e, f))))


@scalar("st_crosses")
def st_crosses(a: Column, b: Column) -> Column:
    """Edges cross, or a line lies on both sides of an area's border."""
    part = lambda line, area: F.exists(coords(line), lambda p: inside(p["x"], p["y"], area) & ~on_edge(p["x"], p["y"], area)) & F.exists(coords(line), lambda p: ~on_or_in(p, area))
    return _cross(a, b) | (is_area(b) & ~is_area(a) & part(a, b)) | (is_area(a) & ~is_area(b) & part(b, a))


@scalar("st_overlaps")
def st_overlaps(a: Column, b: Column) -> Column:
    return _cross(a, b) | (F.exists(coords(b), lambda p: inside(p["x"], p["y"], a)) & ~st_covers(a, b) & ~st_covers(b, a))


def _canonical(c: Column, ring: Column) -> Column:
    """A ring from its least vertex in its lesser direction, a line in its lesser direction."""

    def turns(r: Column) -> Column:
        n = F.size(r)
        return F.array_min(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice(r, i, n), F.slice(r, F.lit(1), i - 1))))

    bare = F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))
    return F.when(ring, F.least(turns(bare), turns(F.reverse(bare)))).otherwise(F.least(c, F.reverse(c)))


@scalar("st_equals")
def st_equals(a: Column, b: Column) -> Column:
    """The same kind and parts, wherever a ring starts and whichever way parts run."""
    normal = lambda g: F.sort_array(F.transform(parts(g), lambda c: _canonical(c, is_area(g))))
    return (st_geometrytype(a) == st_geometrytype(b)) & (normal(a) == normal(b))


@scalar("st_length")
def st_length(g: Column) -> Column:
    return F.aggregate(edges(g), F.lit(0.0), lambda acc, e: acc + haversine(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


@scalar("st_perimeter")
def st_perimeter(g: Column) -> Column:
    return st_length(g)


@scalar("st_area")
def st_area(g: Column) -> Column:
    """Shells less their holes; 0 for points and lines."""

    def ring(c: Column) -> Column:
        twice = F.aggregate(_edges(c), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
        mean_y = F.aggregate(c, F.lit(0.0), lambda acc, p: acc + p["y"]) / F.size(c)
        return F.struct((F.abs(twice) / 2).alias("area"), F.cos(F.radians(mean_y)).alias("scale"))

    def polygon(rings: Column) -> Column:
        shell = F.get(rings, F.lit(0))
        holes = F.aggregate(F.slice(rings, F.lit(2), F.size(rings)), F.lit(0.0), lambda acc, r: acc + r["area"])
        return (shell["area"] - holes) * shell["scale"]

    each = F.transform(polygons(g), lambda rings: let(F.transform(rings, ring), polygon))
    whole = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) * (KM_A_DEGREE * KM_A_DEGREE)
    return F.when(is_area(g), whole).otherwise(F.lit(0.0))


@scalar("st_npoints")
def st_npoints(g: Column) -> Column:
    return F.size(coords(g))


def _point(p: Column) -> Column:
    return st_point(p["x"], p["y"])


@scalar("st_startpoint")
def st_startpoint(g: Column) -> Column:
    return _point(F.get(coords(g), F.lit(0)))


@scalar("st_endpoint")
def st_endpoint(g: Column) -> Column:
    c = coords(g)
    return _point(F.get(c, F.size(c) - 1))


@scalar("st_isring")
def st_isring(g: Column) -> Column:
    """A closed line whose edges meet only their neighbours."""

    def crossed(s: Column) -> Column:
        last = F.size(s) - 1
        apart = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == last))
        return F.exists(s, lambda e: F.exists(s, lambda f: apart(e, f) & meet(e, f)))

    numbered = F.transform(edges(g), lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), i.alias("i")))
    return st_isclosed(g) & ~let(numbered, crossed)


@scalar("st_isclosed")
def st_isclosed(g: Column) -> Column:
    c = coords(g)
    return F.get(c, F.lit(0)) == F.get(c, F.size(c) - 1)


@scalar("st_envelope")
def st_envelope(g: Column) -> Column:
    x, y, X, Y = map(number, bounds(g))
    return F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))", x, y, X, y, X, Y, x, Y, x, y)


@scalar("st_boundary")
def st_boundary(g: Column) -> Column:
    """The rings of an area as lines; other shapes as they are."""
    ring = lambda c: F.concat(F.lit("("), F.array_join(F.transform(c, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ","), F.lit(")"))
    lines = F.transform(parts(g), ring)
    made = F.when(F.size(lines) == 1, F.concat(F.lit("LINESTRING"), F.get(lines, F.lit(0)))).otherwise(F.concat(F.lit("MULTILINESTRING("), F.array_join(lines, ","), F.lit(")")))
    return F.when(is_area(g), made).otherwise(g)


@scalar("st_buffer")
def st_buffer(g: Column, km: Column) -> Column:
    """A 16-gon of the given radius around the centroid."""
    x, y = x_of(st_centroid(g)), y_of(st_centroid(g))
    ring = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.concat(number(x + F.cos((i % 16) * F.lit(0.39269908169872414)) * km / (KM_A_DEGREE * F.cos(F.radians(y)))), F.lit(" "), number(y + F.sin((i % 16) * F.lit(0.39269908169872414)) * km / KM_A_DEGREE)))
    return F.concat(F.lit("POLYGON(("), F.array_join(ring, ","), F.lit("))"))


@scalar("st_asgeojson")
def st_asgeojson(g: Column) -> Column:
    pairs = F.array_join(F.transform(coords(g), lambda p: F.concat(F.lit("["), number(p["x"]), F.lit(","), number(p["y"]), F.lit("]"))), ",")
    kind = st_geometrytype(g)
    named = F.when(kind == "POINT", "Point").when(kind == "LINESTRING", "LineString").when(kind == "POLYGON", "Polygon")
    inner = F.when(kind == "POINT", pairs).when(kind == "LINESTRING", F.concat(F.lit("["), pairs, F.lit("]"))).otherwise(F.concat(F.lit("[["), pairs, F.lit("]]")))
    return F.concat(F.lit('{"type":"'), named, F.lit('","coordinates":'), inner, F.lit("}"))


@scalar("st_geomfromgeojson")
def st_geomfromgeojson(s: Column) -> Column:
    kind = F.upper(F.get_json_object(s, "$.type"))
    pairs = F.regexp_extract_all(F.get_json_object(s, "$.coordinates"), F.lit(rf"\[\s*({NUMBER}\s*,\s*{NUMBER})\s*\]"), F.lit(1))
    point = F.regexp_extract(F.get_json_object(s, "$.coordinates"), rf"({NUMBER}\s*,\s*{NUMBER})", 1)
    text = F.array_join(F.transform(pairs, lambda p: F.regexp_replace(p, r"\s*,\s*", " ")), ",")
    return F.when(kind == "POINT", F.concat(F.lit("POINT("), F.regexp_replace(point, r"\s*,\s*", " "), F.lit(")"))).when(kind == "POLYGON", F.concat(F.lit("POLYGON(("), text, F.lit("))"))).otherwise(F.concat(kind, F.lit("("), text, F.lit(")")))
