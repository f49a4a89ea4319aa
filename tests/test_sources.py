import json
import sqlite3
import struct

import pytest

from geoloom import codec, datasets
from geoloom.errors import InvalidOperationError
from geoloom.sources import from_geopandas, read_file, to_geopandas, write_geojson


@pytest.fixture
def cities(tmp_path):
    p = tmp_path / "c.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": f"n{i}", "pop": i * 10}, "geometry": {"type": "Point", "coordinates": [i, -i, 5]}} for i in range(10)]}))
    return str(p)


def test_geojson_options(spark, cities):
    gf = read_file(spark, cities, return_fids=True)
    assert gf.df.columns == ["fid", "name", "pop", "geometry"] and gf.df.count() == 10
    assert read_file(spark, cities, columns=["pop", "name"], read_geometry=False).columns == ["name", "pop"]
    assert read_file(spark, cities, columns=[]).df.columns == ["geometry"]
    assert [r.name for r in read_file(spark, cities, skip_features=3, max_features=2).df.collect()] == ["n3", "n4"]
    assert read_file(spark, cities, where="pop >= 20 AND pop < 50").df.count() == 3
    assert read_file(spark, cities, bbox=(1, -4, 4, 0)).df.count() == 4
    assert [r.name for r in read_file(spark, cities, fids=[7]).df.collect()] == ["n7"]
    assert read_file(spark, cities, sql="SELECT count(*) AS n FROM features").first()["n"] == 10
    flat = read_file(spark, cities, force_2d=True, fids=[2]).df.first()["geometry"]
    assert codec.from_wkb(bytes(flat)) == ("point", (2.0, -2.0))
    with pytest.raises(InvalidOperationError):
        read_file(spark, cities, fids=[1], max_features=1)


def test_lines_round_trip(spark, cities, tmp_path):
    write_geojson(read_file(spark, cities), str(tmp_path / "out.geojsonl"))
    assert read_file(spark, str(tmp_path / "out.geojsonl")).df.count() == 10


def test_geopackage(spark, tmp_path):
    p = str(tmp_path / "a.gpkg")
    con = sqlite3.connect(p)
    con.executescript("CREATE TABLE gpkg_contents(table_name TEXT, data_type TEXT); INSERT INTO gpkg_contents VALUES ('a','features'),('b','features'); CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT); INSERT INTO gpkg_geometry_columns VALUES ('a','geom'),('b','geom'); CREATE TABLE a(fid INTEGER PRIMARY KEY, geom BLOB, v REAL); CREATE TABLE b(fid INTEGER PRIMARY KEY, geom BLOB, s TEXT);")
    con.execute("INSERT INTO a VALUES (1, ?, 2.5)", (b"GP\0\1" + struct.pack("<i", 4326) + codec.to_wkb(("point", (1.0, 2.0))),))
    con.execute("INSERT INTO b VALUES (5, NULL, 'x')")
    con.commit()
    con.close()
    r = read_file(spark, p).df.first()
    assert r["v"] == 2.5 and codec.from_wkb(bytes(r["geometry"])) == ("point", (1.0, 2.0))
    assert read_file(spark, p, layer="b", return_fids=True).df.first()["fid"] == 5


def test_shapefile(spark, tmp_path):
    def record(i, body):
        return struct.pack(">ii", i, len(body) // 2) + body

    shapes = record(1, struct.pack("<i2d", 1, 3.0, 4.0)) + record(2, struct.pack("<i", 0))
    (tmp_path / "s.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + shapes)
    head = struct.pack("<BBBBIHH", 3, 0, 0, 0, 2, 32 + 32 + 1, 6) + b"\0" * 20
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "s.dbf").write_bytes(head + field + b"\x0d" + b" ab   " + b" cd   ")
    rows = read_file(spark, str(tmp_path / "s.shp")).df.collect()
    assert [r["NAME"] for r in rows] == ["ab", "cd"] and rows[1]["geometry"] is None
    assert codec.from_wkb(bytes(rows[0]["geometry"])) == ("point", (3.0, 4.0))


def test_datasets_and_pandas(spark):
    gf = datasets.read_dataset(spark, "naturalearth_cities")
    assert gf.df.count() == 243 and gf.crs == "EPSG:4326"
    assert len(to_geopandas(gf)) == 243
    assert datasets.read_dataset(spark, "nybb").df.schema["BoroCode"].dataType.simpleString() == "bigint"
    with pytest.raises(InvalidOperationError, match="available"):
        datasets.get_path("moon")
    with pytest.raises(InvalidOperationError):
        from_geopandas(spark, 3)


def test_arrow_files_never_meet_on_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from geoloom.frame import GeoFrame
    from geoloom.sources import write_arrow
    from geoloom.types import GeoType

    taken = []
    monkeypatch.setattr(DataFrame, "toArrow", lambda self, f=type(spark.range(0)).toArrow: (taken.append((t := f(self)).num_rows), t)[1])
    monkeypatch.setattr(type(spark.range(0)), "toArrow", DataFrame.toArrow, raising=False)
    t = GeoType("point", "xy", "EPSG:4326", layout="interleaved")
    p = F.struct(F.col("id").cast("double").alias("x"), (-F.col("id").cast("double")).alias("y"))
    rows = spark.range(30_000, numPartitions=1).select("id", F.timestamp_seconds("id").alias("ts"), p.alias("geometry", metadata=t.metadata()))
    path = str(tmp_path / "a.arrow")
    write_arrow(GeoFrame(rows), path, part_bytes=100_000)
    back = read_file(spark, path)
    assert sum(taken) == 0
    files = [f for f in (tmp_path / "a.arrow").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert len(files) == 4 and back.type == t
    assert back.df.exceptAll(rows).isEmpty() and rows.exceptAll(back.df.select(rows.columns)).isEmpty()
    import pyarrow as pa

    assert sum(pa.ipc.open_file(str(f)).read_all().num_rows for f in files) == 30_000
    write_arrow(rows.limit(0), str(tmp_path / "none.arrow"))
    assert read_file(spark, str(tmp_path / "none.arrow")).df.count() == 0
    (tmp_path / "one.arrow").write_bytes(files[0].read_bytes())
    one = read_file(spark, str(tmp_path / "one.arrow"))
    assert one.df.columns == ["id", "ts", "geometry"]


def test_frames_through_pandas_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    from geoloom.frame import GeoFrame
    from geoloom.plans import exchange
    from geoloom.sources import map_geopandas
    from geoloom.types import GeoType

    p = F.struct(F.col("id").cast("double").alias("x"), (-F.col("id").cast("double")).alias("y"))
    rows = spark.range(30_000, numPartitions=3).select("id", p.alias("geometry", metadata=GeoType("point", crs="EPSG:4326").metadata()))

    def refused(*_):
        raise AssertionError("the frame goes through the driver")

    monkeypatch.setattr(type(rows), "toPandas", refused)
    monkeypatch.setattr(exchange, "points", lambda *_: GeoFrame(rows))
    back = map_geopandas(GeoFrame(rows), lambda part: part[part["id"] % 2 == 0])
    assert back.crs == "EPSG:4326" and back.df.count() == 15_000
    flat = exchange.QUERIES["io_pandas"][0](spark, None)
    assert flat.where("x = id AND y = -id").count() == flat.count() == 30_000
