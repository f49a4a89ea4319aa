"""Geometry queries over points (events), lines (lineitem) and boxes (part), with arithmetic SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..frame import GeoColumn, GeoFrame
from ..functions import crs, native
from ..types import GeoType


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tag(df: DataFrame, kind: str, code: str | None = None) -> GeoFrame:
    t = GeoType(kind, crs=code)
    return GeoFrame(df.select("id", F.col("geometry").alias("geometry", metadata=t.metadata())))


def points(spark, sf, code=None) -> GeoFrame:
    e = _t(spark, sf, "events").selectExpr("event_id AS id", "CAST((event_id*7919)%3600 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS x", "CAST((event_id*104729)%1700 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(85 AS DOUBLE) AS y")
    return _tag(e.select("id", native.point(F.col("x"), F.col("y")).alias("geometry")), "point", code)


def lines(spark, sf) -> GeoFrame:
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("double").alias("x"), F.expr("CAST(l_linenumber*10 + l_partkey%10 AS DOUBLE)").alias("y")).alias("v"))
    made = rows.groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("v")).select("id", F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("geometry"))
    return _tag(made, "linestring")


def boxes(spark, sf) -> GeoFrame:
    p = _t(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_partkey%100 AS DOUBLE) AS x0", "CAST(floor(p_partkey/CAST(100 AS DOUBLE)) AS DOUBLE) AS y0", "CAST(p_size AS DOUBLE) AS w", "CAST(p_size%7+1 AS DOUBLE) AS h", "(p_size>=10 AND p_size%7>=2) AS has_hole")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    ring = lambda pts: F.array(*[native.point(a, b) for a, b in pts])
    shell = ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
    hole = ring([(x + 1, y + 1), (x + 1, y + 2), (x + 2, y + 2), (x + 2, y + 1), (x + 1, y + 1)])
    return _tag(p.select("id", F.when(F.col("has_hole"), F.array(shell, hole)).otherwise(F.array(shell)).alias("geometry")), "polygon")


def mixed(spark, sf) -> GeoFrame:
    """WKB of seven cases by key."""
    cases = [("point", (1.0, 2.0)), ("linestring", [(0.0, 0.0), (3.0, 4.0)]), ("linestring", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), ("polygon", [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]), ("multipoint", [(0.0, 0.0), (2.0, 2.0)]), ("linestring", [])]
    k = F.col("p_partkey") % 7
    g = F.lit(None).cast("binary")
    for i, c in enumerate(cases):
        g = F.when(k == i, F.unhex(F.lit(codec.to_wkb(c).hex()))).otherwise(g)
    return _tag(_t(spark, sf, "part").select(F.col("p_partkey").alias("id"), g.alias("geometry")), "wkb")


def _value(gf: GeoFrame, **cols) -> DataFrame:
    return gf.df.select("id", *[(F.round(c, 6) + 0.0 if k.startswith("r_") else c).alias(k.removeprefix("r_")) for k, c in cols.items()])


def _xy(gf: GeoFrame, g: GeoColumn, digits: int = 6) -> DataFrame:
    """Positions as rows, rounded."""
    c = native.coords(g.column, g.type.kind)
    return gf.df.select("id", F.posexplode(c).alias("pos", "p")).select("id", "pos", (F.round("p.x", digits) + 0.0).alias("x"), (F.round("p.y", digits) + 0.0).alias("y"))


def zone31(spark, sf) -> GeoFrame:
    """All points, with longitudes drawn together into UTM zone 31 (0 to 6 degrees)."""
    gf = points(spark, sf, "EPSG:4326")
    p = F.col("geometry")
    return _tag(gf.df.select("id", native.point(p["x"] / 60 + 3, p["y"]).alias("geometry")), "point", "EPSG:4326")


def _utm(s, d) -> DataFrame:
    gf = zone31(s, d)
    return _xy(gf, gf.geometry.to_crs(to_crs="EPSG:32631"), 3).drop("pos")


def _utm_sql() -> str:
    """The series of Krueger written out, on WGS84: third flattening, conformal latitude, four harmonics."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    radius = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    east = " + ".join(f"{v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))
    north = " + ".join(f"{v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))
    conformal = f"SELECT id, radians(x / 60) AS lam, tan(radians(y)) * sqrt(1 + s * s) - s * sqrt(1 + pow(tan(radians(y)), 2)) AS t FROM (SELECT *, sinh({e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(y)))) AS s FROM points)"
    sphere = f"SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM ({conformal})"
    return f"WITH {P} SELECT id, {_r(f'500000 + {radius!r}::DOUBLE * (eta + {east})', 3)} AS x, {_r(f'{radius!r}::DOUBLE * (xi + {north})', 3)} AS y FROM ({sphere})"


P = "points AS (SELECT event_id AS id, CAST((event_id*7919)%3600 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS x, CAST((event_id*104729)%1700 AS DOUBLE)/CAST(10 AS DOUBLE) - CAST(85 AS DOUBLE) AS y FROM events)"
L = "lines AS (SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber*10 + l_partkey%10 AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq FROM lineitem), segs AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY seq) AS px, lag(y) OVER (PARTITION BY id ORDER BY seq) AS py FROM lines)"
X = "boxes AS (SELECT p_partkey AS id, CAST(p_partkey%100 AS DOUBLE) AS x0, CAST(floor(p_partkey/CAST(100 AS DOUBLE)) AS DOUBLE) AS y0, CAST(p_size AS DOUBLE) AS w, CAST(p_size%7+1 AS DOUBLE) AS h, CASE WHEN p_size>=10 AND p_size%7>=2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hole FROM part)"
BP = f"{X}, verts AS (SELECT id, w, h, x0, y0, pos, CASE pos WHEN 0 THEN x0 WHEN 1 THEN x0+w WHEN 2 THEN x0+w WHEN 3 THEN x0 WHEN 4 THEN x0 WHEN 5 THEN x0+1 WHEN 6 THEN x0+1 WHEN 7 THEN x0+2 WHEN 8 THEN x0+2 ELSE x0+1 END AS x, CASE pos WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y0+h WHEN 3 THEN y0+h WHEN 4 THEN y0 WHEN 5 THEN y0+1 WHEN 6 THEN y0+2 WHEN 7 THEN y0+2 WHEN 8 THEN y0+1 ELSE y0+1 END AS y FROM boxes CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS pos) WHERE pos < 5 OR hole = 1)"


def _r(e: str, n: int = 6) -> str:
    return f"round({e}, {n}) + 0.0::DOUBLE"


def _matrix(a, b, d, e, ox, oy) -> str:
    """Rows of an affine map of boxes about (ox, oy)."""
    a, b, d, e = (f"CAST({v!r} AS DOUBLE)" for v in (a, b, d, e))
    return f"WITH {BP} SELECT id, pos, {_r(f'({a}*x + {b}*y) + ({ox} - {a}*({ox}) - {b}*({oy}))')} AS x, {_r(f'({d}*x + {e}*y) + ({oy} - {d}*({ox}) - {e}*({oy}))')} AS y FROM verts"


def _trig(angle: float):
    import math

    return math.cos(math.radians(angle)), math.sin(math.radians(angle)), math.tan(math.radians(angle))


_CX, _CY = "(x0+w/2)", "(y0+h/2)"
_c30, _s30, _t30 = _trig(30)
_t15 = _trig(15)[2]


def _kind_case(values: dict[int, str], other: str = "NULL") -> str:
    return "CASE p_partkey%7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _box_distance(spark, sf):
    b = boxes(spark, sf)
    g = GeoColumn(F.array(F.get(b.df["geometry"], F.lit(0))), GeoType("polygon"))
    p = GeoColumn(native.point(F.lit(10.5), F.lit(10.5)), GeoType("point"))
    return b.df.select("id", (F.round(g.geo.distance(p), 6) + 0.0).alias("d"))


def _codec(spark, sf, form: str):
    parts = []
    for i, gf in enumerate((points(spark, sf), boxes(spark, sf))):
        g = gf.geometry
        c = F.lower(F.hex(crs.encode(g.column, g.type.kind))) if form == "wkb" else crs.as_text(g.column, g.type.kind)
        parts.append(gf.df.select(F.lit(i).alias("part"), "id", c.alias("g")))
    return parts[0].unionByName(parts[1])


def _wkt_sql() -> str:
    n = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
    v = "string_agg(" + n.format("x") + " || ' ' || " + n.format("y") + ", ', ' ORDER BY pos)"
    return f"WITH {P}, {BP} SELECT 0 AS part, id, 'POINT (' || {n.format('x')} || ' ' || {n.format('y')} || ')' AS g FROM points UNION ALL SELECT 1, id, 'POLYGON ((' || {v} FILTER (WHERE pos < 5) || ')' || coalesce(', (' || ({v} FILTER (WHERE pos >= 5)) || ')', '') || ')' FROM verts GROUP BY id"


def _wkb_sql() -> str:
    # Doubles as little-endian hexadecimal through the engine's own geometry codec.
    return f"WITH t AS ({_wkt_sql()}) SELECT part, id, lower(hex(ST_AsWKB(CAST(g AS GEOMETRY)))) AS g FROM t"


def _geodesic(spark, sf, method):
    gf = lines(spark, sf)
    g = GeoColumn(gf.geometry.column, GeoType("linestring"))
    return gf.df.select("id", F.round(g.geo.geodesic_length(method), 3).alias("length"))


def _blobs(gf: GeoFrame) -> GeoFrame:
    """The same geometries as WKB, so that the batch operators run instead of the native ones."""
    g = gf.geometry
    return _tag(gf.df.select("id", crs.encode(g.column, g.type.kind).alias("geometry")), "wkb")


def _wkb_boxes(spark, sf) -> DataFrame:
    gf = _blobs(boxes(spark, sf))
    geo = gf.geometry.geo
    turned = geo.scale(2.0, -0.5).geo
    return _value(gf, r_area=geo.area, r_length=geo.euclidean_length(), r_x=geo.centroid.geo.x, r_y=geo.centroid.geo.y, r_hull=geo.convex_hull().geo.area, r_box=geo.envelope().geo.area, r_scaled=turned.area, r_cx=turned.centroid.geo.x, e=geo.is_empty(), t=geo.geom_type)


def _wkb_points(spark, sf) -> DataFrame:
    gf = _blobs(points(spark, sf))
    geo = gf.geometry.geo
    moved = geo.translate(3.0, 4.0)
    return _value(gf, x=geo.x, y=geo.y, r_moved=geo.distance(moved), r_north=moved.geo.y)


def _flagship(spark, sf):
    """Distance of suppliers to a fixed place, by nation."""
    s = _t(spark, sf, "supplier").select("s_nationkey", native.point(F.expr("CAST(s_suppkey*37%360 AS DOUBLE) - 180"), F.expr("CAST(s_suppkey*17%170 AS DOUBLE) - 85")).alias("geometry", metadata=GeoType("point").metadata()))
    near = GeoFrame(s).geometry.geo.distance(GeoColumn(native.point(F.lit(10.0), F.lit(20.0)), GeoType("point")))
    d = s.select("s_nationkey", near.alias("d")).where("d < 120")
    return d.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("d"), 6) + 0.0).alias("mean_distance"))


QUERIES = {
    "geo_supplier_distance": (_flagship, "SELECT s_nationkey, count(*) AS n, " + _r("avg(d)") + " AS mean_distance FROM (SELECT s_nationkey, sqrt((10-x)*(10-x)+(20-y)*(20-y)) AS d FROM (SELECT s_nationkey, CAST(s_suppkey*37%360 AS DOUBLE) - 180 AS x, CAST(s_suppkey*17%170 AS DOUBLE) - 85 AS y FROM supplier)) WHERE d < 120 GROUP BY 1"),
    "geo_x": (lambda s, d: _value(gf := points(s, d), x=gf.geometry.geo.x), f"WITH {P} SELECT id, x FROM points"),
    "geo_y": (lambda s, d: _value(gf := points(s, d), y=gf.geometry.geo.y), f"WITH {P} SELECT id, y FROM points"),
    "geo_translate": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.translate(2.5, -1.25)), f"WITH {BP} SELECT id, pos, {_r('x + 2.5')} AS x, {_r('y - 1.25')} AS y FROM verts"),
    "geo_scale": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.scale(2.0, -0.5)), _matrix(2.0, 0.0, 0.0, -0.5, _CX, _CY)),
    "geo_rotate": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.rotate(30), 4), _matrix(_c30, -_s30, _s30, _c30, _CX, _CY).replace(", 6) + 0.0", ", 4) + 0.0")),
    "geo_skew": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.skew(30, 15), 4), _matrix(1.0, _t30, _t15, 1.0, _CX, _CY).replace(", 6) + 0.0", ", 4) + 0.0")),
    "geo_affine": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.affine_transform([2, 3, -1, 4, 5, 6])), f"WITH {BP} SELECT id, pos, {_r('2*x + 3*y + 5')} AS x, {_r('-x + 4*y + 6')} AS y FROM verts"),
    "geo_area": (lambda s, d: _value(gf := boxes(s, d), r_area=gf.geometry.geo.area), f"WITH {X} SELECT id, {_r('w*h - hole')} AS area FROM boxes"),
    "geo_length": (lambda s, d: _value(gf := lines(s, d), r_length=gf.geometry.geo.euclidean_length()), f"WITH {L} SELECT id, {_r('coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))), 0)')} AS length FROM segs GROUP BY id"),
    "geo_length_polygon": (lambda s, d: _value(gf := boxes(s, d), r_length=gf.geometry.geo.euclidean_length()), f"WITH {X} SELECT id, {_r('2*(w+h) + 4*hole')} AS length FROM boxes"),
    "geo_centroid": (lambda s, d: _value(gf := boxes(s, d), r_x=gf.geometry.geo.centroid.geo.x, r_y=gf.geometry.geo.centroid.geo.y), f"WITH {X} SELECT id, {_r('(w*h*(x0+w/2) - hole*(x0+1.5)) / (w*h - hole)')} AS x, {_r('(w*h*(y0+h/2) - hole*(y0+1.5)) / (w*h - hole)')} AS y FROM boxes"),
    "geo_envelope": (lambda s, d: _xy(gf := lines(s, d), gf.geometry.geo.envelope()), f"WITH {L}, b AS (SELECT id, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM lines GROUP BY id) SELECT id, pos, CASE WHEN pos IN (1, 2) THEN c ELSE a END AS x, CASE WHEN pos IN (2, 3) THEN d ELSE b END AS y FROM b CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS pos)"),
    "geo_exterior": (lambda s, d: _xy(gf := boxes(s, d), gf.geometry.geo.exterior()), f"WITH {BP} SELECT id, pos, x, y FROM verts WHERE pos < 5"),
    "geo_convex_hull_area": (lambda s, d: _value(gf := boxes(s, d), r_area=gf.geometry.geo.convex_hull().geo.area), f"WITH {X} SELECT id, {_r('w*h')} AS area FROM boxes"),
    "geo_geom_type": (lambda s, d: _value(gf := mixed(s, d), t=gf.geometry.geo.geom_type), "SELECT p_partkey AS id, " + _kind_case({0: "'Point'", 1: "'LineString'", 2: "'LineString'", 3: "'Polygon'", 4: "'MultiPoint'", 5: "'LineString'"}) + " AS t FROM part"),
    "geo_is_empty": (lambda s, d: _value(gf := mixed(s, d), e=gf.geometry.geo.is_empty()), "SELECT p_partkey AS id, " + _kind_case({5: "true", 6: "NULL"}, "false") + " AS e FROM part"),
    "geo_is_ring": (lambda s, d: _value(gf := mixed(s, d), e=gf.geometry.geo.is_ring()), "SELECT p_partkey AS id, " + _kind_case({2: "true", 6: "NULL"}, "false") + " AS e FROM part"),
    "geo_distance_pp": (lambda s, d: _value(gf := points(s, d), r_d=gf.geometry.geo.distance(GeoColumn(native.point(F.lit(1.0), F.lit(2.0)), GeoType("point")))), f"WITH {P} SELECT id, {_r('sqrt((1-x)*(1-x)+(2-y)*(2-y))')} AS d FROM points"),
    "geo_distance_box": (_box_distance, f"WITH {X} SELECT id, {_r('sqrt(pow(greatest(x0-10.5, 0, 10.5-x0-w), 2) + pow(greatest(y0-10.5, 0, 10.5-y0-h), 2))')} AS d FROM boxes"),
    "geo_haversine": (lambda s, d: _geodesic(s, d, "haversine"), f"WITH {L} SELECT id, round(coalesce(sum(2*6371008.8*asin(least(1, sqrt(pow(sin(radians(y-py)/2), 2) + cos(radians(py))*cos(radians(y))*pow(sin(radians(x-px)/2), 2))))) FILTER (WHERE px IS NOT NULL), 0), 3) AS length FROM segs GROUP BY id"),
    "geo_geodesic": (lambda s, d: _geodesic(s, d, "geodesic"), None),
    "geo_vincenty": (lambda s, d: _geodesic(s, d, "vincenty"), None),
    "geo_to_crs_3857": (lambda s, d: _xy(gf := points(s, d, "EPSG:4326"), gf.geometry.to_crs(to_crs="EPSG:3857"), 3).drop("pos"), f"WITH {P} SELECT id, {_r('x*pi()/180*6378137', 3)} AS x, {_r('ln(tan(pi()/4 + y*pi()/360))*6378137', 3)} AS y FROM points"),
    "geo_to_crs_utm": (_utm, _utm_sql()),
    "geo_to_crs_utm_back": (lambda s, d: _xy(gf := zone31(s, d), gf.geometry.to_crs(to_crs="EPSG:32631").to_crs(to_crs="EPSG:4326")).drop("pos"), f"WITH {P} SELECT id, {_r('x/60 + 3')} AS x, {_r('y')} AS y FROM points"),
    "geo_wkb": (lambda s, d: _codec(s, d, "wkb"), _wkb_sql()),
    "geo_wkb_boxes": (_wkb_boxes, f"WITH {X} SELECT id, {_r('w*h - hole')} AS area, {_r('2*(w+h) + 4*hole')} AS length, {_r('(w*h*(x0+w/2) - hole*(x0+1.5)) / (w*h - hole)')} AS x, {_r('(w*h*(y0+h/2) - hole*(y0+1.5)) / (w*h - hole)')} AS y, {_r('w*h')} AS hull, {_r('w*h')} AS box, {_r('w*h - hole')} AS scaled, {_r('x0 + w/2 + 2*((w*h*(x0+w/2) - hole*(x0+1.5)) / (w*h - hole) - x0 - w/2)')} AS cx, false AS e, 'Polygon' AS t FROM boxes"),
    "geo_wkb_points": (_wkb_points, f"WITH {P} SELECT id, x, y, 5.0::DOUBLE AS moved, {_r('y + 4')} AS north FROM points"),
    "geo_wkb_lengths": (lambda s, d: _value(gf := _blobs(lines(s, d)), r_length=gf.geometry.geo.euclidean_length()), f"WITH {L} SELECT id, {_r('coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py))), 0)')} AS length FROM segs GROUP BY id"),
    "geo_wkt": (lambda s, d: _codec(s, d, "wkt"), _wkt_sql()),
    "geo_total_bounds": (lambda s, d: points(s, d).total_bounds(), f"WITH {P} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points"),
    "read_bbox": (lambda s, d: _value(gf := GeoFrame(points(s, d).df.where(native.intersects_box(F.col("geometry"), "point", -20, -10, 30, 40))), x=gf.geometry.geo.x), f"WITH {P} SELECT id, x FROM points WHERE x BETWEEN -20 AND 30 AND y BETWEEN -10 AND 40"),
    "read_where": (lambda s, d: points(s, d).df.where("id % 7 = 3 AND id >= 100").select("id"), f"WITH {P} SELECT id FROM points WHERE id % 7 = 3 AND id >= 100"),
    "read_limit": (lambda s, d: points(s, d).df.orderBy("id").offset(10).limit(25).select("id"), f"WITH {P} SELECT id FROM points ORDER BY id LIMIT 25 OFFSET 10"),
}
