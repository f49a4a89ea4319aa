import itertools

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom import codec
from geoloom.errors import ComputeError, SchemaError
from geoloom.sources import from_arrow, to_arrow
from geoloom.types import DEPTH, DIMS, GeoType

SAMPLE = {"point": lambda p: p, "linestring": lambda p: [p, p], "multipoint": lambda p: [p, p], "polygon": lambda p: [[p, p, p, p]], "multilinestring": lambda p: [[p, p]], "multipolygon": lambda p: [[[p, p, p, p]]]}


@pytest.mark.parametrize("kind,dim", list(itertools.product(SAMPLE, DIMS)))
def test_wkb_and_wkt_round_trip(kind, dim):
    geom = kind, SAMPLE[kind](tuple(float(i) for i in range(len(dim))))
    assert codec.from_wkb(codec.to_wkb(geom, dim)) == geom
    assert codec.from_wkt(codec.to_wkt(geom, dim)) == geom


def test_collections_empties_and_bad_input():
    nested = ("geometrycollection", [("point", (1.0, 2.0)), ("geometrycollection", [("linestring", [])])])
    assert codec.from_wkb(codec.to_wkb(nested)) == nested
    assert codec.from_wkt(codec.to_wkt(nested)) == nested
    assert codec.from_wkb(codec.to_wkb(("point", None))) == ("point", None)
    for bad in (b"", b"\x02", codec.to_wkb(("point", (1.0, 2.0)))[:-1], codec.to_wkb(("point", (1.0, 2.0))) + b"x"):
        with pytest.raises(ComputeError):
            codec.from_wkb(bad)


@given(st.lists(st.tuples(st.floats(allow_nan=False, allow_infinity=False), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=9))
def test_any_line_round_trips(line):
    assert codec.from_wkb(codec.to_wkb(("linestring", line))) == ("linestring", line)


@pytest.mark.parametrize("kind,dim", list(itertools.product(DEPTH, DIMS)))
def test_fields_round_trip(kind, dim):
    t = GeoType(kind, dim, "EPSG:4326")
    assert GeoType.from_field(t.to_field()) == t and hash(GeoType.from_field(t.to_field())) == hash(t)


def test_storage_that_does_not_fit():
    with pytest.raises(SchemaError):
        GeoType.parse("geoarrow.polygon", GeoType("point").data_type())


def test_tags_survive_and_cross_arrow(spark, tmp_path):
    meta = {"ARROW:extension:name": "geoarrow.point", "ARROW:extension:metadata": '{"crs": "EPSG:4326"}'}
    arr = pa.FixedSizeListArray.from_arrays(pa.array([1.0, 2.0, 3.0, 4.0]), 2)
    table = pa.table([pa.array([1, 2], pa.uint32()), arr], pa.schema([pa.field("n", pa.uint32()), pa.field("geometry", arr.type, metadata=meta)]))
    gf = from_arrow(spark, table)
    assert gf.type == GeoType("point", "xy", "EPSG:4326", layout="interleaved")
    kept = gf.where("n > 1").withColumn("m", F.lit(1))
    assert kept.type.crs == "EPSG:4326"
    kept.df.write.parquet(str(tmp_path / "g"))
    assert GeoType.from_field(spark.read.parquet(str(tmp_path / "g")).schema["geometry"]).crs == "EPSG:4326"
    back = to_arrow(gf)
    assert back.schema.field("geometry").metadata[b"ARROW:extension:name"] == b"geoarrow.point"
    assert back.column("geometry").to_pylist() == [[1.0, 2.0], [3.0, 4.0]]
