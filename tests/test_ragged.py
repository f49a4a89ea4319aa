"""Batches of WKB against the single-geometry kernels."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom import codec
from geoloom.errors import ComputeError
from geoloom.frame import GeoFrame
from geoloom.functions import kernels, ragged
from geoloom.register import register
from geoloom.sources.files import read_file

number = st.integers(-50, 50).map(float)


def _shapes(n):
    p = st.tuples(*[number] * n)
    line = st.lists(p, max_size=5).filter(lambda v: len(v) != 1)
    ring = st.one_of(st.just([]), st.lists(p, min_size=3, max_size=5).map(lambda v: [*v, v[0]]))
    polygon = st.lists(ring, max_size=3)
    simple = {"point": st.one_of(st.none(), p), "linestring": line, "polygon": polygon, "multipoint": st.lists(st.one_of(st.none(), p), max_size=3), "multilinestring": st.lists(line, max_size=3), "multipolygon": st.lists(polygon, max_size=3)}
    one = st.one_of(*[st.tuples(st.just(k), v) for k, v in simple.items()])
    return st.one_of(one, st.tuples(st.just("geometrycollection"), st.lists(one, max_size=3)))


def _close(a, b):
    return (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-9, atol=1e-7, equal_nan=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(2, 4).flatmap(lambda n: _shapes(n).map(lambda g: (g, n))), max_size=8))
def test_batches_equal_single_kernels(made):
    blobs = [codec.to_wkb(g, {2: "xy", 3: "xyz", 4: "xyzm"}[n]) for g, n in made]
    b = ragged.decode(pa.array(blobs, pa.binary()))
    geoms = [codec.from_wkb(x) for x in blobs]
    assert _close(b.area(), [kernels.area(g) for g in geoms])
    assert _close(b.length(), [kernels.length(g) for g in geoms])
    assert b.is_empty().tolist() == [codec.empty(g) for g in geoms]
    assert b.is_ring().tolist() == [kernels.is_ring(g) for g in geoms]
    assert [ragged._TITLE[c] for c in b.code.tolist()] == [kernels.title(g) for g in geoms]
    for got, want in zip(b.bounds(), map(kernels.bounds, geoms), strict=True):
        assert _close(None if np.isnan(got).all() else got, want)
    for got, want in zip(ragged._envelope(b), map(kernels.envelope, geoms), strict=True):
        assert (got and codec.from_wkb(got)) == want
    shares = [sum(abs(kernels._cross(kernels._xy(r)).sum()) for k, c in kernels.leaves(g) if k == "polygon" for r in c) for g in geoms]
    for i, (got, want) in enumerate(zip(b.centroid(), map(kernels.centroid, geoms), strict=True)):
        # Holes that outweigh the shells leave the weight's rounding to decide.
        if shares[i] == 0 or abs(kernels.area(geoms[i])) > 1e-9:
            assert _close(None if np.isnan(got).all() else got, want and want[1])


def _turned(geom):
    """Big-endian EWKB with an SRID of a point or line."""
    kind, c = geom
    head = struct.pack(">BIi", 0, codec.CODES[kind] | 0x20000000, 4326)
    return head + (struct.pack(">2d", *c) if kind == "point" else struct.pack(">I", len(c)) + b"".join(struct.pack(">2d", *p) for p in c))


def test_other_byte_orders_and_heads():
    geoms = [("point", (3.0, 4.0)), ("linestring", [(0.0, 0.0), (3.0, 4.0)])]
    b = ragged.decode(pa.array([_turned(g) for g in geoms] + [codec.to_wkb(geoms[1])], pa.binary()))
    assert b.length().tolist() == [0, 5, 5] and b.xy[0].tolist() == [3, 4] and b.plain.tolist() == [False, False, True]


@pytest.mark.parametrize("bad", [b"", b"\x02", codec.to_wkb(("point", (1.0, 2.0)))[:-1], codec.to_wkb(("point", (1.0, 2.0))) + b"x", struct.pack("<BI", 1, 9), struct.pack("<BII", 1, 2, 1 << 31), struct.pack("<BII", 1, 7, 5)])
def test_malformed_geometries_are_named(bad):
    good = codec.to_wkb(("point", (1.0, 2.0)))
    with pytest.raises(ComputeError):
        ragged.decode(pa.array([good, bad, good], pa.binary()))


GEOMS = [("point", (1.0, 2.0)), ("point", None), ("linestring", [(0.0, 0.0), (3.0, 4.0)]), ("polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]]), ("multipoint", [(0.0, 0.0), (2.0, 2.0)]), ("geometrycollection", [("point", (9.0, 9.0)), ("linestring", [(0.0, 0.0), (1.0, 1.0)])])]


def _frame(spark):
    rows = [(i, None if g is None else bytearray(codec.to_wkb(g))) for i, g in enumerate([*GEOMS, None])]
    return GeoFrame(spark.createDataFrame(rows, "id int, geometry binary").repartition(2))


def test_columns_and_maps_through_spark(spark):
    gf = _frame(spark)
    geo = gf.geometry.geo
    maps = {"moved": ((1.0, 0.0, 0.0, 1.0, 5.0, 6.0), None, geo.translate(5, 6)), "about": ((2.0, 0.0, 0.0, 3.0, 0.0, 0.0), "center", geo.scale(2, 3)), "fixed": ((2.0, 0.0, 0.0, 2.0, 0.0, 0.0), (1.0, 1.0), geo.scale(2, 2, origin=(1, 1)))}
    rows = gf.df.select("id", geo.area.alias("area"), geo.geom_type.alias("kind"), geo.geodesic_length("vincenty").alias("far"), geo.distance(geo.centroid).alias("away"), *[c.column.alias(k) for k, (_, _, c) in maps.items()]).collect()
    assert len(rows) == len(GEOMS) + 1
    for r in rows:
        if r["id"] == len(GEOMS):
            assert all(v is None for k, v in r.asDict().items() if k != "id")
            continue
        g = GEOMS[r["id"]]
        centre = kernels.centroid(g)
        assert r["kind"] == kernels.title(g) and math.isclose(r["area"], kernels.area(g))
        assert math.isclose(r["far"], kernels.geodesic_length(g, "vincenty"))
        assert r["away"] == (centre and kernels.distance(g, centre))
        for k, (matrix, origin, _) in maps.items():
            assert codec.from_wkb(bytes(r[k])) == kernels.affine(g, matrix, origin)


def test_sql_names(spark):
    register(spark)
    _frame(spark).df.createOrReplaceTempView("shapes")
    rows = spark.sql("SELECT id, st_area(geometry) a, st_length(geometry) l, st_geom_type(geometry) k, st_as_text(st_centroid(geometry)) c, st_distance(geometry, geometry) d, st_is_ring(geometry) r FROM shapes").collect()
    for r in rows:
        g = ([*GEOMS, None])[r["id"]]
        assert r["a"] == (None if g is None else kernels.area(g)) and r["l"] == (None if g is None else kernels.length(g))
        assert r["d"] == (None if g is None or codec.empty(g) else 0.0) and r["r"] == (None if g is None else False)
        assert r["c"] == (None if g is None or codec.empty(g) else codec.to_wkt(kernels.centroid(g)))


def test_box_of_wkb(spark, tmp_path):
    path = str(tmp_path / "shapes.parquet")
    _frame(spark).df.write.parquet(path)
    for box in ((0, 0, 0.5, 0.5), (3.5, 0, 9, 0.5), (8, 8, 10, 10), (1.2, 1.2, 1.8, 1.8), (-9, -9, -8, -8)):
        x0, y0, x1, y1 = box
        frame = ("polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])
        got = {r["id"] for r in read_file(spark, path, bbox=box).df.select("id").collect()}
        assert got == {i for i, g in enumerate(GEOMS) if kernels.distance(g, frame) == 0}


def test_empty_batches():
    b = ragged.decode(pa.array([], pa.binary()))
    assert b.n == 0 and b.area().tolist() == [] and b.centroid().shape == (0, 2) and b.bounds().shape == (0, 4)
    assert ragged.distances(pa.array([None], pa.binary()), pa.array([None], pa.binary())).to_pylist() == [None]
