"""Generated stand-ins for small bundled datasets, written as Arrow files on first use."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import SparkSession

from . import codec
from .errors import InvalidOperationError
from .sources.arrow import from_arrow

available = ("naturalearth_cities", "naturalearth_lowres", "nybb")


def _square(x: float, y: float, s: float):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


def _table(name: str) -> pa.Table:
    if name == "naturalearth_cities":  # 243 points on a lattice
        geoms = [("point", (float((i * 37) % 360 - 180), float((i * 17) % 170 - 85))) for i in range(243)]
        cols = {"name": [f"City {i}" for i in range(243)]}
    elif name == "nybb":
        geoms = [("multipolygon", [_square(i * 10.0, 0.0, 4.0), _square(i * 10.0 + 5, 5.0, 2.0)]) for i in range(5)]
        cols = {"BoroCode": pa.array(range(1, 6), pa.uint32()), "Shape_Leng": pa.array([24.0] * 5, pa.float32()), "Shape_Area": pa.array([20.0] * 5, pa.float32())}
    else:
        geoms = [("polygon", _square(float(i % 36 * 10 - 180), float(i // 36 * 10 - 80), 8.0)) for i in range(177)]
        cols = {"pop_est": pa.array([i * 1000 for i in range(177)], pa.uint64()), "gdp_md_est": pa.array([i * 1.5 for i in range(177)], pa.float32())}
    table = pa.table(cols)
    meta = {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": '{"crs": "EPSG:4326"}'}
    return table.append_column(pa.field("geometry", pa.binary(), metadata=meta), pa.array(map(codec.to_wkb, geoms), pa.binary()))


def get_path(name: str) -> str:
    """Path of a dataset's Arrow file."""
    if name not in available:
        raise InvalidOperationError(f"no dataset {name!r}; available: {', '.join(available)}")
    path = os.path.join(tempfile.gettempdir(), f"geoloom-{os.getuid()}-{name}.arrow")
    if not os.path.exists(path):
        t = _table(name)
        with pa.OSFile(path + ".tmp", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t)
        os.replace(path + ".tmp", path)
    return path


def read_dataset(spark: SparkSession, name: str):
    with pa.OSFile(get_path(name), "rb") as f:
        return from_arrow(spark, pa.ipc.open_file(f).read_all())
