"""Geometry measures and constructions as Catalyst expressions on typed columns.

Every function takes the column and its kind (see geoloom.types); a null geometry gives null. Only x and
y enter; further coordinates pass through affine maps unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GeometryTypeError, InvalidOperationError
from ..types import DEPTH, TITLES

EARTH_RADIUS = 6371008.8  # metres, IUGG mean


def _typed(kind: str, *allowed: str) -> None:
    if kind not in (allowed or DEPTH):
        raise GeometryTypeError(f"not defined for {kind}; use {', '.join(allowed or DEPTH)}")


def let(value: Column, body) -> Column:
    """body(value), with value computed once and null passed on."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def coords(g: Column, kind: str) -> Column:
    """All positions as one array."""
    _typed(kind)
    if kind == "point":
        return F.when(g.isNotNull(), F.array(g))
    return {1: lambda: g, 2: lambda: F.flatten(g), 3: lambda: F.flatten(F.flatten(g))}[DEPTH[kind]]()


def map_coords(g: Column, kind: str, f) -> Column:
    def down(c, depth):
        return f(c) if depth == 0 else F.transform(c, lambda x: down(x, depth - 1))

    return F.when(g.isNotNull(), down(g, DEPTH[kind]))


def _segments(line: Column, f) -> Column:
    """f(p, q) of consecutive positions."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), f)


def _rings(g: Column, kind: str) -> Column:
    return F.flatten(g) if kind == "multipolygon" else g


def _lines(g: Column, kind: str) -> Column:
    """Arrays of positions whose segments count: lines and rings."""
    return {"linestring": lambda: F.array(g), "multilinestring": lambda: g, "polygon": lambda: g, "multipolygon": lambda: F.flatten(g)}[kind]()


def _ring_cross(ring: Column) -> Column:
    """Twice the signed area, measured from the first vertex."""
    o = F.get(ring, F.lit(0))
    return total(_segments(ring, lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])))


def area(g: Column, kind: str) -> Column:
    """Unsigned; holes subtract; 0 without area."""
    _typed(kind)
    if kind not in ("polygon", "multipolygon"):
        return F.when(g.isNotNull(), F.lit(0.0))
    one = lambda rings: total(F.transform(rings, lambda r, i: F.when(F.size(r) > 0, F.abs(_ring_cross(r)) / 2 * F.when(i == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return F.when(g.isNotNull(), one(g) if kind == "polygon" else total(F.transform(g, one)))


def length(g: Column, kind: str) -> Column:
    """Sum of segments; of all rings for polygons."""
    _typed(kind)
    if kind in ("point", "multipoint"):
        return F.when(g.isNotNull(), F.lit(0.0))
    seg = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    return F.when(g.isNotNull(), total(F.transform(_lines(g, kind), lambda r: total(_segments(r, seg)))))


def haversine_length(g: Column, kind: str) -> Column:
    """Metres along great circles on a sphere; x longitude, y latitude."""
    _typed(kind)
    if kind in ("point", "multipoint"):
        return F.when(g.isNotNull(), F.lit(0.0))

    def seg(p, q):
        u = F.sin(F.radians(q["y"] - p["y"]) / 2)
        v = F.sin(F.radians(q["x"] - p["x"]) / 2)
        return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(u * u + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * v * v)))

    return F.when(g.isNotNull(), total(F.transform(_lines(g, kind), lambda r: total(_segments(r, seg)))))


def is_empty(g: Column, kind: str) -> Column:
    _typed(kind)
    if kind == "point":
        return F.when(g.isNotNull(), F.coalesce(F.isnan(g["x"]) & F.isnan(g["y"]), F.lit(True)))
    return F.when(g.isNotNull(), F.size(coords(g, kind)) == 0)


def bounds(g: Column, kind: str) -> Column:
    """struct(xmin, ymin, xmax, ymax); null if empty."""
    c = coords(g, kind)
    pick = lambda f, k: f(F.transform(c, lambda p: p[k]))
    return F.when(~is_empty(g, kind), F.struct(pick(F.array_min, "x").alias("xmin"), pick(F.array_min, "y").alias("ymin"), pick(F.array_max, "x").alias("xmax"), pick(F.array_max, "y").alias("ymax")))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def envelope(g: Column, kind: str) -> Column:
    """Smallest axis-parallel rectangle as a polygon; a point for points."""
    if kind == "point":
        return g
    ring = lambda b: F.array(F.array(*[point(b[x], b[y]) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))]))
    return F.when(~is_empty(g, kind), let(bounds(g, kind), ring))


def _mean(c: Column) -> Column:
    n = F.size(c)
    return F.when(n > 0, point(total(F.transform(c, lambda p: p["x"])) / n, total(F.transform(c, lambda p: p["y"])) / n))


def _weighted(parts: Column) -> Column:
    """Point from array of struct(w, x, y), null if the weights sum to 0."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda a, p: F.struct((a["w"] + p["w"]).alias("w"), (a["x"] + p["w"] * p["x"]).alias("x"), (a["y"] + p["w"] * p["y"]).alias("y"))
    return F.aggregate(parts, start, add, lambda a: F.when(a["w"] != 0, point(a["x"] / a["w"], a["y"] / a["w"])))


def _by_length(lines: Column) -> Column:
    seg = lambda p, q: F.struct(F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])).alias("w"), ((p["x"] + q["x"]) / 2).alias("x"), ((p["y"] + q["y"]) / 2).alias("y"))
    return _weighted(F.flatten(F.transform(lines, lambda r: _segments(r, seg))))


def centroid(g: Column, kind: str) -> Column:
    """Area-weighted; without area by length; without length the mean; null if empty."""
    _typed(kind)
    if kind == "point":
        return F.when(~is_empty(g, kind), point(g["x"], g["y"]))
    c = coords(g, kind)
    if kind == "multipoint":
        return F.when(g.isNotNull(), _mean(c))
    lines = _lines(g, kind)
    if kind in ("linestring", "multilinestring"):
        return F.when(g.isNotNull(), F.coalesce(_by_length(lines), _mean(c)))

    def ring(r, i):
        o = F.get(r, F.lit(0))

        def seg(p, q):
            px, py, qx, qy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"]
            cross = px * qy - qx * py
            return F.struct(cross.alias("a"), ((px + qx) * cross).alias("x"), ((py + qy) * cross).alias("y"))

        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        add = lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"))
        sign = F.when(i == 0, 1.0).otherwise(-1.0)
        return F.aggregate(_segments(r, seg), start, add, lambda s: F.when(s["a"] != 0, F.struct((F.abs(s["a"]) * sign).alias("w"), (o["x"] + s["x"] / (3 * s["a"])).alias("x"), (o["y"] + s["y"] / (3 * s["a"])).alias("y"))).otherwise(F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))

    one = lambda rings: F.transform(F.filter(rings, lambda r: F.size(r) > 0), ring)
    parts = one(g) if kind == "polygon" else F.flatten(F.transform(g, one))
    return F.when(g.isNotNull(), F.coalesce(_weighted(parts), _by_length(lines), _mean(c)))


def exterior(g: Column, kind: str) -> Column:
    """Outer ring of a polygon as a line; null for other kinds."""
    return F.get(g, F.lit(0)) if kind == "polygon" else F.lit(None).cast("array<struct<x:double,y:double>>")


def interiors(g: Column, kind: str) -> Column:
    _typed(kind, "polygon")
    return F.when(g.isNotNull(), F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))))


def geom_type(g: Column, kind: str) -> Column:
    _typed(kind)
    return F.when(g.isNotNull(), F.lit(TITLES[kind]))


def is_ring(g: Column, kind: str) -> Column:
    """True for a line that ends where it starts."""
    _typed(kind)
    if kind != "linestring":
        return F.when(g.isNotNull(), F.lit(False))
    a, b = F.get(g, F.lit(0)), F.element_at(g, F.lit(-1))
    return F.when(g.isNotNull(), F.when(F.size(g) > 0, (a["x"] == b["x"]) & (a["y"] == b["y"])).otherwise(False))


def x(g: Column, kind: str) -> Column:
    _typed(kind, "point")
    return g["x"]


def y(g: Column, kind: str) -> Column:
    _typed(kind, "point")
    return g["y"]


def _moved(p: Column, dim: str, nx: Column, ny: Column) -> Column:
    return F.struct(nx.alias("x"), ny.alias("y"), *[p[c].alias(c) for c in dim[2:]])


def affine(g: Column, kind: str, matrix, dim: str = "xy") -> Column:
    """Matrix [a, b, d, e, xoff, yoff]: x' = a x + b y + xoff, y' = d x + e y + yoff."""
    _typed(kind)
    if len(matrix) != 6:
        raise InvalidOperationError("the affine matrix has 6 numbers: [a, b, d, e, xoff, yoff]")
    a, b, d, e, xo, yo = (m if isinstance(m, Column) else F.lit(float(m)) for m in matrix)
    return map_coords(g, kind, lambda p: _moved(p, dim, a * p["x"] + b * p["y"] + xo, d * p["x"] + e * p["y"] + yo))


def translate(g: Column, kind: str, xoff: float = 0.0, yoff: float = 0.0, dim: str = "xy") -> Column:
    return affine(g, kind, [1, 0, 0, 1, xoff, yoff], dim)


def _origin(g: Column, kind: str, origin) -> Column:
    if isinstance(origin, str):
        name = origin.lower()
        if name == "center":
            return let(bounds(g, kind), lambda b: point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2))
        if name == "centroid":
            return centroid(g, kind)
        raise InvalidOperationError(f"Invalid argument {origin!r}: use center, centroid or a point")
    if isinstance(origin, Column):
        return origin
    if isinstance(origin, dict):
        px, py = origin["x"], origin["y"]
    elif hasattr(origin, "x"):
        px, py = origin.x, origin.y
    else:
        px, py = origin
    return point(F.lit(float(px)), F.lit(float(py)))


def _about(g: Column, kind: str, origin, matrix, dim: str) -> Column:
    """Affine map about an origin; unchanged where there is none (empty)."""
    a, b, d, e = matrix
    moved = let(_origin(g, kind, origin), lambda o: F.when(o.isNotNull(), affine(g, kind, [F.lit(a), F.lit(b), F.lit(d), F.lit(e), o["x"] - a * o["x"] - b * o["y"], o["y"] - d * o["x"] - e * o["y"]], dim)))
    return F.coalesce(moved, g)


def rotate(g: Column, kind: str, angle: float, origin="center", dim: str = "xy") -> Column:
    """Degrees, counter-clockwise."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return _about(g, kind, origin, (c, -s, s, c), dim)


def scale(g: Column, kind: str, xfact: float = 1.0, yfact: float = 1.0, origin="center", dim: str = "xy") -> Column:
    return _about(g, kind, origin, (float(xfact), 0.0, 0.0, float(yfact)), dim)


def skew(g: Column, kind: str, xs: float = 0.0, ys: float = 0.0, origin="center", dim: str = "xy") -> Column:
    return _about(g, kind, origin, (1.0, math.tan(math.radians(xs)), math.tan(math.radians(ys)), 1.0), dim)


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def intersects_box(g: Column, kind: str, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Whether the bounding boxes meet (borders count)."""
    if kind == "point":
        return (g["x"] >= xmin) & (g["x"] <= xmax) & (g["y"] >= ymin) & (g["y"] <= ymax)
    return let(bounds(g, kind), lambda b: (b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))
