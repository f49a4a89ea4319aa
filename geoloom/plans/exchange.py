"""Sources, sinks and Arrow exchange: tables are written in a format, read back and compared with the table."""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec, datasets
from ..frame import GeoColumn, GeoFrame
from ..functions import crs, native
from ..register import register
from ..session import put, shared_folder
from ..sources import from_arrow, from_data, from_xy, map_geopandas, read_file, to_arrow, write_arrow, write_geojson
from ..streaming import windowed_bounds
from ..types import DEPTH, GeoType
from .geo import BP, L, P, _t, boxes, lines, mixed, points


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{name}"


def _flat(gf: GeoFrame, *more) -> DataFrame:
    """x and y of a WKB point column, with other columns."""
    g = crs.decode(gf.df[gf.geometry_name], "point")
    return gf.df.select(*more, g["x"].alias("x"), g["y"].alias("y"))


def _lines_file(spark, sf) -> str:
    path = _folder(spark, ".geojsonl")
    write_geojson(points(spark, sf), path)
    return path


def _cities(spark, sf, parts: int | None = None) -> GeoFrame:
    """Suppliers as points, in the order of their keys."""
    s = _t(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CAST(s_suppkey % 360 AS DOUBLE) - 180 AS x", "CAST(s_suppkey % 170 AS DOUBLE) - 85 AS y").orderBy("id")
    return from_xy(s.coalesce(parts) if parts else s, "x", "y", crs="EPSG:4326")


def _one_file(spark, sf) -> str:
    path = _folder(spark, ".geojsonl")
    write_geojson(_cities(spark, sf, 1), path)
    return path


def _collection(spark, sf, z: bool = False) -> str:
    """Nations as one GeoJSON feature collection."""
    import json

    path = _folder(spark, ".geojson")
    rows = _t(spark, sf, "nation").orderBy("n_nationkey").collect()
    feature = lambda r: {"type": "Feature", "properties": {"id": r["n_nationkey"], "name": r["n_name"]}, "geometry": {"type": "Point", "coordinates": [r["n_nationkey"] * 1.5, -r["n_nationkey"] * 1.0, *([7.0] if z else [])]}}
    put(spark, path, json.dumps({"type": "FeatureCollection", "features": [feature(r) for r in rows]}).encode())
    return path


def _package(spark, sf) -> str:
    """Regions and nations as two layers of a GeoPackage."""
    path = _folder(spark, ".gpkg")
    with tempfile.TemporaryDirectory() as d:  # SQLite writes to the driver's disk; the bytes go to the shared folder
        con = sqlite3.connect(os.path.join(d, "a.gpkg"))
        con.execute("CREATE TABLE gpkg_contents(table_name TEXT, data_type TEXT)")
        con.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT)")
        for layer, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")):
            con.execute("INSERT INTO gpkg_contents VALUES (?, 'features')", (layer,))
            con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (layer,))
            con.execute(f"CREATE TABLE {layer}(fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, half DOUBLE, even BOOLEAN)")
            for r in _t(spark, sf, layer).collect():
                k = r[key]
                con.execute(f"INSERT INTO {layer} VALUES (?, ?, ?, ?, ?)", (k + 1, b"GP\0\1" + struct.pack("<i", 4326) + codec.to_wkb(("point", (float(k), float(-k)))), r[name], k / 2, k % 2 == 0))
        con.commit()
        con.close()
        with open(os.path.join(d, "a.gpkg"), "rb") as f:
            put(spark, path, f.read())
    return path


def _shape(spark, sf) -> str:
    """Regions as a Shapefile whose names are Latin-1."""
    path = _folder(spark, ".shp")
    rows = _t(spark, sf, "region").orderBy("r_regionkey").collect()
    record = lambda i, body: struct.pack(">ii", i, len(body) // 2) + body
    shapes = b"".join(record(i + 1, struct.pack("<i2d", 1, float(r["r_regionkey"]), 9.5)) for i, r in enumerate(rows))
    field = lambda name, kind, width: name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    head = struct.pack("<BBBBIHH", 3, 0, 0, 0, len(rows), 32 + 64 + 1, 1 + 20 + 6) + b"\0" * 20
    body = b"".join(b" " + f"{r['r_name']}é".encode("latin-1").ljust(20) + str(r["r_regionkey"]).rjust(6).encode() for r in rows)
    put(spark, path, struct.pack(">i", 9994) + b"\0" * 96 + shapes)
    put(spark, path[:-4] + ".dbf", head + field(b"NAME", b"C", 20) + field(b"ID", b"N", 6) + b"\x0d" + body)
    return path


def _ipc(spark, sf) -> str:
    path = _folder(spark, ".arrow")
    write_arrow(boxes(spark, sf), path)
    return path


def _verts(gf: GeoFrame) -> DataFrame:
    g = gf.geometry
    return gf.df.select("id", F.posexplode(native.coords(g.column, g.type.kind)).alias("pos", "p")).select("id", "pos", "p.x", "p.y")


def _parquet(spark, sf) -> GeoFrame:
    path = _folder(spark, ".parquet")
    boxes(spark, sf).df.write.parquet(path)
    return read_file(spark, path)


def _summed(positions, c: str):
    return F.aggregate(positions, F.lit(0.0), lambda acc, p: acc + p[c])


def _arrow_kind(kind: str, dim: str = "xy", layout: str = "separated"):
    """Round trip of one geometry type and layout through Arrow."""

    def run(spark, sf):
        n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
        value = F.col("id").cast("double")
        g = F.struct(*[(value * (i + 1)).alias(c) for i, c in enumerate(dim)])
        for _ in range(DEPTH[kind]):
            g = F.array(g, g)
        t = GeoType(kind, dim, "EPSG:4326", layout=layout)
        back = from_arrow(spark, to_arrow(GeoFrame(n.select("id", g.alias("geometry", metadata=t.metadata())))))
        assert back.type == t, (back.type, t)
        flat = F.col("geometry")
        for _ in range(DEPTH[kind] - 1):
            flat = F.flatten(flat)
        flat = flat if DEPTH[kind] else F.array(flat)
        return back.df.select("id", F.size(flat).cast("long").alias("n"), *[_summed(flat, c).alias(f"sum_{c}") for c in dim])

    return run


def _arrow_sql(kind: str, dim: str = "xy") -> str:
    n = 2 ** DEPTH[kind]
    return f"SELECT n_nationkey AS id, {n}::BIGINT AS n, " + ", ".join(f"CAST(n_nationkey * {i + 1} * {n} AS DOUBLE) AS sum_{c}" for i, c in enumerate(dim)) + " FROM nation"


def _arrow_wkb(spark, sf):
    """WKB through Arrow, in plain, large and view storage."""
    table = to_arrow(mixed(spark, sf))
    kinds = [("plain", pa.binary()), ("large", pa.large_binary()), ("view", pa.binary_view())]
    out = None
    for name, kind in kinds:
        i = table.schema.get_field_index("geometry")
        own = table.set_column(i, pa.field("geometry", kind, True, table.schema.field(i).metadata), table.column(i).cast(kind))
        gf = from_arrow(spark, own)
        part = gf.df.select(F.lit(name).alias("storage"), "id", gf.geometry.geo.geom_type.alias("t"))
        out = part if out is None else out.unionByName(part)
    return out


def _pandas(spark, sf):
    """A frame through GeoPandas where it is installed, else pandas with WKB, a batch at a time."""
    return _flat(map_geopandas(points(spark, sf), lambda part: part), "id")


def _data(spark, sf):
    """Frames from rows, and from columns."""
    rows = [(i, (float(i), -float(i))) for i in range(7)]
    one = from_data(spark, rows, columns=["id", "geometry"], orient="row", kind="point")
    two = from_data(spark, [[r[0] + 10 for r in rows], [r[1] for r in rows]], columns=["id", "geometry"], orient="col", kind="point")
    three = from_data(spark, {"id": [20], "geometry": [(1.5, 2.5)]}, kind="point")
    out = one.union(two).union(three)
    return out.df.select("id", out.geometry.geo.x.alias("x"), out.geometry.geo.y.alias("y"))


def _sql_names(spark, sf):
    register(spark)
    mixed(spark, sf).df.createOrReplaceTempView("geoloom_mixed")
    return spark.sql("SELECT id, st_geom_type(geometry) AS t FROM geoloom_mixed")


def _equality(spark, sf):
    a, b = boxes(spark, sf), _parquet(spark, sf)
    other = a.df.where("id > 1")
    pairs = [("same", a.frame_equal(b)), ("fewer", a.frame_equal(other)), ("names", a.frame_equal(a.rename("id", "key"))), ("twice", a.frame_equal(a.df.unionByName(other)))]
    return spark.createDataFrame(pairs, "name string, equal boolean")


def _streamed_bounds(spark, sf):
    p = _t(spark, sf, "events").selectExpr("event_id AS id", "ts", "CAST(event_id % 100 AS DOUBLE) AS x", "CAST(event_id % 37 AS DOUBLE) AS y")
    return windowed_bounds(p, "ts", "x", "y", size="1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "xmin", "ymin", "xmax", "ymax")


def _limited(spark, sf):
    got = read_file(spark, _one_file(spark, sf), skip_features=10, max_features=25)
    return _flat(got, "id", "name")


NATION = "SELECT n_nationkey AS id, n_name AS name, n_nationkey * 1.5::DOUBLE AS x, CAST(-n_nationkey AS DOUBLE) AS y FROM nation"
SUPPLIER = "SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 360 AS DOUBLE) - 180 AS x, CAST(s_suppkey % 170 AS DOUBLE) - 85 AS y FROM supplier"
KINDS = "CASE p_partkey%7 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'LineString' WHEN 3 THEN 'Polygon' WHEN 4 THEN 'MultiPoint' WHEN 5 THEN 'LineString' END"

# Vincenty's inverse formula on WGS 84, twenty rounds from the spherical start.
VINCENTY = f"""
WITH RECURSIVE {L}, s AS (
  SELECT id, seq, radians(x - px) AS l, atan((1 - 1/298.257223563) * tan(radians(py))) AS u1, atan((1 - 1/298.257223563) * tan(radians(y))) AS u2 FROM segs WHERE px IS NOT NULL AND (x <> px OR y <> py)
), it AS (
  SELECT id, seq, l, u1, u2, 0 AS k, l AS lam FROM s
  UNION ALL
  SELECT id, seq, l, u1, u2, k + 1, l + (1 - c) * (1/298.257223563) * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
  FROM (SELECT *, (1/298.257223563) / 16 * ca2 * (4 + (1/298.257223563) * (4 - 3 * ca2)) AS c FROM
    (SELECT *, CASE WHEN ca2 = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / ca2 END AS c2m FROM
      (SELECT *, 1 - sa * sa AS ca2 FROM
        (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa, atan2(ss, cs) AS sig FROM
          (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE k < 20)))))
), e AS (
  SELECT id, seq, ss, cs, atan2(ss, cs) AS sig, sa, 1 - sa * sa AS ca2, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS c2m
  FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM
    (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it WHERE k = 20))
), f AS (
  SELECT *, ca2 * (pow(6378137.0::DOUBLE, 2) - pow(6378137.0::DOUBLE * (1 - 1/298.257223563), 2)) / pow(6378137.0::DOUBLE * (1 - 1/298.257223563), 2) AS u FROM e
), g AS (
  SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS a, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS b FROM f
), h AS (
  SELECT id, 6378137.0::DOUBLE * (1 - 1/298.257223563) * a * (sig - b * ss * (c2m + b / 4 * (cs * (2 * c2m * c2m - 1) - b / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))) AS d FROM g
)
SELECT i.id, round(coalesce(sum(d), 0), 3) AS length FROM (SELECT DISTINCT id FROM lines) i LEFT JOIN h USING (id) GROUP BY i.id
"""


def _geodesic_pair(spark, sf):
    """The kernel's geodesic length agrees with Vincenty's to a millimetre."""
    gf = lines(spark, sf)
    g = GeoColumn(gf.geometry.column, GeoType("linestring"))
    return gf.df.select("id", (F.abs(g.geo.geodesic_length("geodesic") - g.geo.geodesic_length("vincenty")) < 0.001).alias("close"))


QUERIES = {
    "io_geojson_lines": (lambda s, d: _flat(read_file(s, _lines_file(s, d)), "id"), f"WITH {P} SELECT id, x, y FROM points"),
    "io_geojson_collection": (lambda s, d: _flat(read_file(s, _collection(s, d)), "id", "name"), NATION),
    "io_bbox": (lambda s, d: _flat(read_file(s, _lines_file(s, d), bbox=(-20, -10, 30, 40)), "id"), f"WITH {P} SELECT id, x, y FROM points WHERE x BETWEEN -20 AND 30 AND y BETWEEN -10 AND 40"),
    "io_where": (lambda s, d: read_file(s, _lines_file(s, d), where="id % 7 = 3 AND id >= 100").df.select("id"), f"WITH {P} SELECT id FROM points WHERE id % 7 = 3 AND id >= 100"),
    "io_limits": (_limited, f"{SUPPLIER} ORDER BY s_suppkey LIMIT 25 OFFSET 10"),
    "io_columns": (lambda s, d: read_file(s, _one_file(s, d), columns=["name"], read_geometry=False), "SELECT s_name AS name FROM supplier"),
    "io_fids": (lambda s, d: read_file(s, _collection(s, d), fids=[2, 5, 7], return_fids=True).df.select("fid", "name"), "SELECT n_nationkey::BIGINT AS fid, n_name AS name FROM nation WHERE n_nationkey IN (2, 5, 7)"),
    "io_sql": (lambda s, d: read_file(s, _collection(s, d), sql="SELECT substr(name, 1, 1) AS first, 'features' AS word, count(*) AS n_features FROM features GROUP BY 1"), "SELECT substr(n_name, 1, 1) AS first, 'features' AS word, count(*) AS n_features FROM nation GROUP BY 1"),
    "io_force_2d": (lambda s, d: _flat(gf := read_file(s, _collection(s, d, z=True), force_2d=True), "id", F.octet_length(gf.df["geometry"]).cast("long").alias("size")), f"SELECT id, 21::BIGINT AS size, x, y FROM ({NATION})"),
    "io_geopackage": (lambda s, d: _flat(read_file(s, _package(s, d)), "name", "half", "even"), "SELECT r_name AS name, r_regionkey / 2 AS half, r_regionkey % 2 = 0 AS even, CAST(r_regionkey AS DOUBLE) AS x, CAST(-r_regionkey AS DOUBLE) AS y FROM region"),
    "io_layer": (lambda s, d: _flat(read_file(s, _package(s, d), layer="nation", return_fids=True), "fid", "name"), "SELECT n_nationkey::BIGINT + 1 AS fid, n_name AS name, CAST(n_nationkey AS DOUBLE) AS x, CAST(-n_nationkey AS DOUBLE) AS y FROM nation"),
    "io_shapefile_encoding": (lambda s, d: _flat(read_file(s, _shape(s, d), encoding="latin-1"), "NAME", "ID"), "SELECT r_name || 'é' AS NAME, r_regionkey::BIGINT AS ID, CAST(r_regionkey AS DOUBLE) AS x, 9.5::DOUBLE AS y FROM region"),
    "io_arrow_file": (lambda s, d: _verts(read_file(s, _ipc(s, d))), f"WITH {BP} SELECT id, pos, x, y FROM verts"),
    "io_parquet": (lambda s, d: _verts(_parquet(s, d)), f"WITH {BP} SELECT id, pos, x, y FROM verts"),
    "io_dataset": (lambda s, d: _flat(datasets.read_dataset(s, "naturalearth_cities"), "name"), "SELECT 'City ' || i AS name, CAST((i * 37) % 360 - 180 AS DOUBLE) AS x, CAST((i * 17) % 170 - 85 AS DOUBLE) AS y FROM range(243) t(i)"),
    "io_pandas": (_pandas, f"WITH {P} SELECT id, x, y FROM points"),
    "io_data": (_data, "SELECT i AS id, CAST(i AS DOUBLE) AS x, CAST(-i AS DOUBLE) AS y FROM range(7) t(i) UNION ALL SELECT i + 10, CAST(i AS DOUBLE), CAST(-i AS DOUBLE) FROM range(7) t(i) UNION ALL SELECT 20, 1.5::DOUBLE, 2.5::DOUBLE"),
    "io_registered_names": (_sql_names, f"SELECT p_partkey AS id, {KINDS} AS t FROM part"),
    "arrow_wkb": (_arrow_wkb, f"SELECT storage, p_partkey AS id, {KINDS} AS t FROM part, (SELECT unnest(['plain', 'large', 'view']) AS storage)"),
    **{f"arrow_{k}": (_arrow_kind(k), _arrow_sql(k)) for k in DEPTH},
    **{f"arrow_point_{dim}_{layout}": (_arrow_kind("point", dim, layout), _arrow_sql("point", dim)) for dim, layout in (("xyz", "separated"), ("xyzm", "separated"), ("xy", "interleaved"), ("xyz", "interleaved"))},
    "arrow_linestring_interleaved": (_arrow_kind("linestring", "xy", "interleaved"), _arrow_sql("linestring")),
    "frame_equal": (_equality, "SELECT unnest(['same', 'fewer', 'names', 'twice']) AS name, unnest([true, false, false, false]) AS equal"),
    "stream_windowed_bounds": (_streamed_bounds, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, min(CAST(event_id % 100 AS DOUBLE)) AS xmin, min(CAST(event_id % 37 AS DOUBLE)) AS ymin, max(CAST(event_id % 100 AS DOUBLE)) AS xmax, max(CAST(event_id % 37 AS DOUBLE)) AS ymax FROM events GROUP BY 1"),
    "geo_geodesic_vincenty": (_geodesic_pair, f"WITH {L} SELECT DISTINCT id, true AS close FROM lines"),
}
