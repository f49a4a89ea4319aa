"""Geometry types: logical kinds, dimensions, storage, column metadata, Arrow fields.

A typed geometry is nested arrays of coordinate structs with the type in the column's metadata
(GeoArrow extension keys), so the tag survives filters, joins and Parquet. Mixed geometries are WKB.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import IntEnum

import pyarrow as pa
from pyspark.sql import types as T

from .errors import SchemaError

NAME_KEY, META_KEY, DIM_KEY, LAYOUT_KEY = "ARROW:extension:name", "ARROW:extension:metadata", "geo:dim", "geo:coord_layout"


class GeometryType(IntEnum):
    """Numbers used by GEOS (not those of WKB)."""

    MISSING = -1
    POINT = 0
    LINESTRING = 1
    LINEARRING = 2
    POLYGON = 3
    MULTIPOINT = 4
    MULTILINESTRING = 5
    MULTIPOLYGON = 6
    GEOMETRYCOLLECTION = 7


# Nesting depth of arrays around the coordinate struct.
DEPTH = {"point": 0, "linestring": 1, "multipoint": 1, "polygon": 2, "multilinestring": 2, "multipolygon": 3}
KINDS = (*DEPTH, "geometrycollection", "geometry", "box", "wkb", "wkt")
TITLES = {"point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon", "geometrycollection": "GeometryCollection"}
DIMS = ("xy", "xyz", "xym", "xyzm")


@dataclass(frozen=True)
class GeoType:
    """A geometry type: equal and hashed by all its parts."""

    kind: str
    dim: str = "xy"
    crs: str | None = None
    edges: str | None = None
    layout: str = "separated"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise SchemaError(f"unknown geometry kind {self.kind!r}; one of {', '.join(KINDS)}")
        if self.dim not in DIMS:
            raise SchemaError(f"unknown dimension {self.dim!r}; one of {', '.join(DIMS)}")
        if self.layout not in ("separated", "interleaved"):
            raise SchemaError(f"unknown coordinate layout {self.layout!r}")

    @property
    def name(self) -> str:
        return f"geoarrow.{self.kind}"

    @property
    def typed(self) -> bool:
        return self.kind in DEPTH

    def serialize(self) -> str:
        return json.dumps({k: v for k, v in (("crs", self.crs), ("edges", self.edges)) if v is not None})

    def metadata(self) -> dict[str, str]:
        return {NAME_KEY: self.name, META_KEY: self.serialize(), DIM_KEY: self.dim, LAYOUT_KEY: self.layout}

    def with_kind(self, kind: str) -> GeoType:
        return GeoType(kind, self.dim, self.crs, self.edges, self.layout)

    def with_crs(self, crs: str | None) -> GeoType:
        return GeoType(self.kind, self.dim, crs, self.edges, self.layout)

    def coord_type(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.DoubleType()) for c in self.dim])

    def data_type(self) -> T.DataType:
        if self.kind == "wkt":
            return T.StringType()
        if self.kind in ("wkb", "geometry", "geometrycollection"):
            return T.BinaryType()
        if self.kind == "box":
            return T.StructType([T.StructField(f"{c}{end}", T.DoubleType()) for end in ("min", "max") for c in self.dim])
        out: T.DataType = self.coord_type()
        for _ in range(DEPTH[self.kind]):
            out = T.ArrayType(out)
        return out

    def to_field(self, name: str = "geometry") -> T.StructField:
        return T.StructField(name, self.data_type(), True, self.metadata())

    @staticmethod
    def parse(name: str, storage: T.DataType, metadata: str | None = None, dim: str | None = None, layout: str | None = None) -> GeoType:
        """Type from an extension name and metadata; SchemaError if the storage does not fit."""
        kind = name.removeprefix("geoarrow.")
        more = json.loads(metadata) if metadata else {}
        crs = more.get("crs")
        inner = storage
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        found = "".join(inner.names) if kind in DEPTH and isinstance(inner, T.StructType) else None
        out = GeoType(kind, found if found in DIMS else dim or "xy", crs if crs is None or isinstance(crs, str) else json.dumps(crs), more.get("edges"), layout or "separated")
        if out.data_type().simpleString() != storage.simpleString():
            raise SchemaError(f"{name} cannot be stored as {storage.simpleString()}; expected {out.data_type().simpleString()}")
        return out

    @staticmethod
    def from_field(field: T.StructField) -> GeoType | None:
        """Type of a tagged column; None without a tag."""
        m = field.metadata or {}
        return GeoType.parse(m[NAME_KEY], field.dataType, m.get(META_KEY), m.get(DIM_KEY), m.get(LAYOUT_KEY)) if NAME_KEY in m else None


def from_arrow_field(field: pa.Field) -> GeoType | None:
    """Geometry type of an Arrow field with extension metadata."""
    m = {k.decode(): v.decode() for k, v in (field.metadata or {}).items()}
    if NAME_KEY not in m:
        return None
    kind, t, fixed = m[NAME_KEY].removeprefix("geoarrow."), field.type, None
    while pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        fixed = t.list_size if pa.types.is_fixed_size_list(t) else fixed
        t = t.value_type
    more = json.loads(m.get(META_KEY) or "{}")
    crs = more.get("crs")
    crs = crs if crs is None or isinstance(crs, str) else json.dumps(crs)
    if kind in DEPTH:
        dim = m.get(DIM_KEY) or ({2: "xy", 3: "xyz", 4: "xyzm"}[fixed] if fixed else "".join(f.name for f in t))
        return GeoType(kind, dim, crs, more.get("edges"), "interleaved" if fixed else "separated")
    return GeoType(kind, m.get(DIM_KEY, "xy"), crs, more.get("edges"))
