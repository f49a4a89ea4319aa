import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom import codec
from geoloom.errors import CrsError, InvalidOperationError
from geoloom.frame import GeoColumn, GeoFrame, asof
from geoloom.functions import kernels as K
from geoloom.register import register
from geoloom.types import GeoType

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]


def frame(spark, kind, geoms):
    t = GeoType(kind)
    df = spark.createDataFrame([(i, g) for i, g in enumerate(geoms)], f"id long, geometry {t.data_type().simpleString()}")
    return GeoFrame(df).with_geometry(GeoColumn(df["geometry"], t))


def values(gf, col):
    return [r[0] for r in gf.df.orderBy("id").select(col).collect()]


@pytest.mark.parametrize("typed", [True, False])
def test_box_with_hole_like_jts(spark, typed):
    gf = frame(spark, "polygon", [[SQUARE, HOLE], None]) if typed else frame(spark, "wkb", [codec.to_wkb(("polygon", [SQUARE, HOLE])), None])
    g = gf.geometry.geo
    assert values(gf, g.area) == [11.0, None]
    assert values(gf, g.euclidean_length()) == [18.0, None]
    assert values(gf, g.geom_type) == ["Polygon", None]
    assert values(gf, g.is_empty()) == [False, None]
    x = values(gf, g.centroid.geo.x)
    assert x[0] == pytest.approx(22.5 / 11) and x[1] is None
    assert values(gf, g.rotate(90).geo.area)[0] == pytest.approx(11)
    assert values(gf, g.scale(2, -3).geo.area)[0] == pytest.approx(66)
    assert values(gf, g.skew(20, 0, "centroid").geo.area)[0] == pytest.approx(11)
    assert values(gf, g.translate(5, 5).geo.envelope().geo.area)[0] == 12.0
    assert values(gf, g.distance(GeoColumn(F.struct(F.lit(1.5).alias("x"), F.lit(1.5).alias("y")), GeoType("point"))))[0] == 0.5


def test_jts_agrees(spark):
    jts = spark._jvm.org.locationtech.jts
    rng = np.random.default_rng(3)
    for _ in range(20):
        pts = [tuple(p) for p in rng.uniform(-9, 9, (7, 2)).round(2).tolist()]
        geom = ("linestring", pts)
        j = jts.io.WKTReader().read(codec.to_wkt(geom))
        assert K.length(geom) == pytest.approx(j.getLength())
        assert K.area(K.convex_hull(geom)) == pytest.approx(j.convexHull().getArea())
        c = j.getCentroid()
        assert K.centroid(geom)[1] == pytest.approx((c.getX(), c.getY()))
        other = ("polygon", [SQUARE, HOLE])
        assert K.distance(geom, other) == pytest.approx(j.distance(jts.io.WKTReader().read(codec.to_wkt(other))), abs=1e-12)


def test_degenerate_cases(spark):
    assert K.centroid(("polygon", [[(0.0, 0.0), (2.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]))[1] == (1.0, 0.0)
    assert K.centroid(("geometrycollection", [("point", (9.0, 9.0)), ("linestring", [(0.0, 0.0), (2.0, 0.0)])]))[1] == (1.0, 0.0)
    gf = frame(spark, "linestring", [[], [(1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]])
    g = gf.geometry.geo
    assert values(gf, g.is_empty()) == [True, False, False]
    assert values(gf, g.is_ring()) == [False, True, True]
    assert values(gf, g.euclidean_length()) == [0.0, 0.0, 2.0]
    assert values(gf, g.rotate(30).column)[0] == []
    for bad in (lambda: g.affine_transform([1, 2]), lambda: g.geodesic_length("flat"), lambda: g.rotate(1, "corner"), lambda: g.x):
        with pytest.raises(InvalidOperationError):
            bad()


def test_geodesics():
    assert K.geodesic(np.zeros(1), np.zeros(1), np.ones(1), np.zeros(1))[0] == pytest.approx(111319.490793274, abs=1e-6)
    assert K.geodesic(np.zeros(1), np.array([-30.0]), np.array([179.8]), np.array([29.9]))[0] == pytest.approx(19989832.827610, abs=1e-4)
    rng = np.random.default_rng(1)
    a = rng.uniform(-80, 80, (4, 500))
    assert np.abs(K.geodesic(*a) - K.vincenty(*a)).max() < 1e-3


def test_projections(spark):
    df = spark.createDataFrame([(1, (9.0, 48.0))], "id long, geometry struct<x:double,y:double>")
    gf = GeoFrame(df).with_geometry(GeoColumn(df["geometry"], GeoType("point", crs="EPSG:4326")))
    r = gf.to_crs("EPSG:32632").df.first()["geometry"]
    assert r["x"] == pytest.approx(500000.0) and r["y"] == pytest.approx(5316300, abs=500)
    back = gf.to_crs("EPSG:32632").to_crs("EPSG:3857").to_crs("EPSG:4326").df.first()["geometry"]
    assert (back["x"], back["y"]) == pytest.approx((9.0, 48.0), abs=1e-9)
    with pytest.raises(CrsError, match="supported"):
        gf.to_crs("EPSG:2056")


def test_sql_names_asof_and_stream(spark, tmp_path):
    register(spark)
    r = spark.sql("SELECT st_area(g) a, st_as_text(st_centroid(g)) c, st_point_distance(0, 0, 3, 4) d FROM (SELECT st_geom_from_text('POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))') g)").first()
    assert tuple(r) == (4.0, "POINT (1 1)", 5.0)
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, t int, v string")
    assert sorted(tuple(x) for x in asof(left, right, "t", "k").select("k", "t", "v").collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    df = spark.createDataFrame([(1, (3.0, 4.0))], "id long, geometry struct<x:double,y:double>")
    df.write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    out = GeoFrame(s).df.select(GeoColumn(F.col("geometry"), GeoType("point")).geo.distance(GeoColumn(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), GeoType("point"))).alias("d"))
    q = out.writeStream.format("memory").queryName("geo_stream").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT d FROM geo_stream").first()[0] == 5.0
    assert math.isclose(K.area(("polygon", [SQUARE])), 12)
