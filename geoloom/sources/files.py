"""Vector files: GeoJSON (and line-delimited GeoJSON), GeoPackage, Shapefile, Arrow IPC, Parquet.

Files are opened by Spark's readers, so any store Spark reads will do. Line-delimited GeoJSON is split across
tasks; the binary formats are one task a file (an Arrow file goes through the driver, as its types do).
"""

from __future__ import annotations

import datetime
import os
import re
import sqlite3
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..errors import ComputeError, InvalidOperationError, NotFoundError
from ..frame import GeoColumn, GeoFrame
from ..functions import kernels, native, ragged
from ..types import GeoType
from .arrow import read_arrow


def _geojson(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(fid, properties..., geometry WKB) of a feature collection, or of one feature a line."""
    import json

    reader = spark.read.option("multiLine", not lines)
    schema = reader.json(path).schema
    feature = schema if lines else schema["features"].dataType.elementType
    has = "properties" in feature.names
    props = feature["properties"].dataType.simpleString() if has and feature["properties"].dataType.typeName() == "struct" else None
    one = "geometry string" + (f", properties {props}" if props else "")
    if lines:
        rows = reader.schema(one).json(path).select(F.monotonically_increasing_id().alias("fid"), *[F.col(c) for c in (("properties",) if props else ())], "geometry")
    else:
        rows = reader.schema(f"features array<struct<{', '.join(':'.join(p.split(' ', 1)) for p in one.split(', properties ')[:1])}{', properties:' + props if props else ''}>>").json(path).select(F.posexplode("features").alias("fid", "f")).select(F.col("fid").cast("long").alias("fid"), *([F.col("f.properties").alias("properties")] if props else []), F.col("f.geometry").alias("geometry"))

    @F.pandas_udf("binary")
    def wkb(s):
        return s.map(lambda v: None if v is None else codec.to_wkb(codec.from_geojson(json.loads(v))))

    return rows.select("fid", *(["properties.*"] if props else []), wkb("geometry").alias("geometry"))


def _rows_to_frame(spark: SparkSession, path: str, parse, arg) -> DataFrame:
    """Rows of parse(file bytes, arg), read where the file's task runs; the schema comes from the first file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.first()
    if first is None:
        raise NotFoundError(f"no file at {path}")
    schema = parse(bytes(first["content"]), arg).schema

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                yield from parse(content, arg).cast(schema).to_batches()

    from pyspark.sql.pandas.types import from_arrow_schema

    return files.select("content").mapInArrow(run, from_arrow_schema(schema))


def _gpkg(content: bytes, layer) -> pa.Table:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(content)
        f.flush()
        con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        names = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]
        name = names[layer or 0] if not isinstance(layer, str) else layer
        if name not in names:
            raise NotFoundError(f"no layer {name!r}; layers: {', '.join(names)}")
        (geom,) = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (name,)).fetchone()
        info = con.execute(f'PRAGMA table_info("{name}")').fetchall()
        cols = [(c[1], (c[2] or "TEXT").upper(), bool(c[5])) for c in info]
        rows = con.execute(f'SELECT * FROM "{name}" ORDER BY rowid').fetchall()
        con.close()

    def strip(v):
        if v is None:
            return None
        if v[:2] != b"GP":
            raise ComputeError("not a GeoPackage geometry")
        return bytes(v[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(v[3] >> 1) & 7] :])

    out = {}
    for i, (c, t, key) in enumerate(cols):
        values = [r[i] for r in rows]
        if c == geom:
            out["geometry"] = pa.array(map(strip, values), pa.binary())
        else:
            kind = pa.int64() if "INT" in t else pa.float64() if t.startswith(("REAL", "DOUBLE", "FLOAT")) else pa.bool_() if t.startswith("BOOL") else pa.binary() if t.startswith("BLOB") else pa.string()
            out["fid" if key else c] = pa.array([bool(v) if kind == pa.bool_() and v is not None else v for v in values], kind)
    return pa.table(out)


def _shp(content: bytes) -> list:
    if struct.unpack(">i", content[:4])[0] != 9994:
        raise ComputeError("not a shapefile")
    at, out = 100, []
    while at + 8 <= len(content):
        (words,) = struct.unpack(">i", content[at + 4 : at + 8])
        rec = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack("<i", rec[:4])
        base = kind % 10
        if base == 0:
            out.append(None)
        elif base == 1:
            out.append(("point", struct.unpack("<2d", rec[4:20])))
        elif base == 8:
            (n,) = struct.unpack("<i", rec[36:40])
            flat = struct.unpack(f"<{2 * n}d", rec[40 : 40 + 16 * n])
            out.append(("multipoint", list(zip(flat[::2], flat[1::2], strict=True))))
        elif base in (3, 5):
            parts, n = struct.unpack("<2i", rec[36:44])
            cut = [*struct.unpack(f"<{parts}i", rec[44 : 44 + 4 * parts]), n]
            flat = struct.unpack(f"<{2 * n}d", rec[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            p = list(zip(flat[::2], flat[1::2], strict=True))
            lines = [p[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if base == 3:
                out.append(("linestring", lines[0]) if parts == 1 else ("multilinestring", lines))
                continue
            polys = []
            for r in lines:  # clockwise rings are shells, the holes follow theirs
                if kernels._cross(kernels._xy(r)).sum() <= 0 or not polys:
                    polys.append([r])
                else:
                    polys[-1].append(r)
            out.append(("polygon", polys[0]) if len(polys) == 1 else ("multipolygon", polys))
        else:
            raise ComputeError(f"unsupported shape type {kind}")
    return out


def _dbf(content: bytes, encoding: str | None) -> pa.Table:
    n, head, size = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        raw = content[at : at + 32]
        fields.append((raw[:11].split(b"\0")[0].decode(), chr(raw[11]), raw[16], raw[17]))
        at += 32
    out = {f[0]: [] for f in fields}
    for i in range(n):
        rec = content[head + i * size : head + (i + 1) * size]
        if rec[:1] == b"*":
            continue
        at = 1
        for name, kind, width, _ in fields:
            text = rec[at : at + width].decode(encoding or "utf-8", "replace").strip("\0 ")
            at += width
            out[name].append(_dbf_value(text, kind))
    kinds = {"C": pa.string(), "D": pa.date32(), "L": pa.bool_(), "F": pa.float64()}
    return pa.table({f[0]: pa.array(out[f[0]], kinds.get(f[1]) or (pa.float64() if f[3] else pa.int64())) for f in fields})


def _dbf_value(text: str, kind: str):
    if not text or text[0] == "*" or (kind == "L" and text == "?"):
        return None
    if kind == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    if kind == "L":
        return text.upper() in "YT"
    if kind in "NF":
        return float(text) if kind == "F" or "." in text else int(text)
    return text


def _shapefile(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """Both files meet in one task; the driver reads only the table's header."""
    stem = os.path.splitext(path)[0]
    files = spark.read.format("binaryFile").load([stem + ".shp", stem + ".dbf"]).select(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ext"), "content")
    head = files.where("ext = 'dbf'").select(F.substring("content", 1, 32 + 32 * 256).alias("head")).first()
    if head is None:
        raise NotFoundError(f"no table beside {path}")
    none = bytearray(head["head"])
    none[4:8] = bytes(4)  # no records
    schema = _dbf(bytes(none), encoding).schema.insert(0, pa.field("fid", pa.int64())).append(pa.field("geometry", pa.binary()))
    both = files.groupBy().agg(*[F.max(F.when(F.col("ext") == e, F.col("content"))).alias(e) for e in ("shp", "dbf")])

    def run(batches):
        for b in batches:
            for shp, dbf in zip(b.column("shp").to_pylist(), b.column("dbf").to_pylist(), strict=True):
                geoms, table = _shp(shp), _dbf(dbf, encoding)
                table = table.append_column("geometry", pa.array([None if g is None else codec.to_wkb(g) for g in geoms], pa.binary()))
                yield from table.add_column(0, "fid", pa.array(range(len(table)), pa.int64())).cast(schema).to_batches()

    from pyspark.sql.pandas.types import from_arrow_schema

    return both.mapInArrow(run, from_arrow_schema(schema))


def _named(sql: str) -> str:
    """The query with the view's name as a placeholder, but not inside literals, quoted names or longer names."""
    plain = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`)|\bfeatures\b""", lambda m: m[1] or "{features}", plain)


def _with_fid(df: DataFrame) -> DataFrame:
    return df if "fid" in df.columns else df.select(F.monotonically_increasing_id().alias("fid"), *df.columns)


def read_file(spark: SparkSession, path: str, *, layer=None, encoding: str | None = None, columns: list[str] | None = None, read_geometry: bool = True, force_2d: bool = False, skip_features: int = 0, max_features: int | None = None, where: str | None = None, bbox: tuple[float, float, float, float] | None = None, fids: list[int] | None = None, sql: str | None = None, sql_dialect: str | None = None, return_fids: bool = False) -> GeoFrame | DataFrame:
    """A vector file as a GeoFrame (a DataFrame without geometry).

    `columns` keeps source order; an empty list keeps none. `where` is a Spark SQL condition, `sql` a Spark SQL
    query over the view `features`. `bbox` keeps geometries that meet the box. `fids` goes with none of
    skip_features, max_features, where and bbox.
    """
    if fids is not None and (skip_features or max_features is not None or where is not None or bbox is not None):
        raise InvalidOperationError("fids cannot be combined with skip_features, max_features, where or bbox")
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".geojson", ".json"):
        df = _geojson(spark, path, lines=False)
    elif ext in (".geojsonl", ".geojsons", ".ndjson", ".jsonl"):
        df = _geojson(spark, path, lines=True)
    elif ext == ".gpkg":
        df = _rows_to_frame(spark, path, _gpkg, layer)
    elif ext == ".shp":
        df = _shapefile(spark, path, encoding)
    elif ext in (".arrow", ".feather", ".ipc"):
        got = read_arrow(spark, path)
        df = got.df if isinstance(got, GeoFrame) else got
    elif ext in (".parquet", ".geoparquet"):
        df = spark.read.parquet(path)
    else:
        raise InvalidOperationError(f"no reader for {ext!r} files")
    df = _with_fid(df)
    geometry = next((f.name for f in df.schema.fields if GeoType.from_field(f)), "geometry" if "geometry" in df.columns else "wkb_geometry" if "wkb_geometry" in df.columns else None)
    if sql is not None:
        if sql_dialect not in (None, "spark"):
            raise InvalidOperationError("sql_dialect: only spark")
        df = spark.sql(_named(sql), features=df)
        df = _with_fid(df)
        geometry = geometry if geometry in df.columns else None
    if fids is not None:
        df = df.where(F.col("fid").isin(list(fids)))
    if where is not None:
        df = df.where(where)
    kind = None if geometry is None else (GeoType.from_field(df.schema[geometry]) or GeoType("wkb"))
    if bbox is not None:
        if geometry is None:
            raise InvalidOperationError("bbox needs a geometry column")
        box = [float(v) for v in bbox]
        if kind.typed:
            df = df.where(native.intersects_box(F.col(geometry), kind.kind, *box))
        elif kind.kind == "wkb":
            df = df.where(ragged.meets_box(F.col(geometry), box))
        else:
            x0, y0, x1, y1 = box
            frame = ("polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])
            df = df.where(F.coalesce(kernels.column(lambda g: kernels.distance(g, frame) == 0, "boolean", F.col(geometry), kind.kind), F.lit(False)))
    if skip_features or max_features is not None:
        df = df.orderBy("fid")
        if skip_features:
            df = df.offset(skip_features)
        if max_features is not None:
            df = df.limit(max_features)
    keep = [c for c in df.columns if c not in ("fid", geometry) and (columns is None or c in columns)]
    df = df.select(*(["fid"] if return_fids else []), *keep, *([geometry] if geometry and read_geometry else []))
    if not geometry or not read_geometry:
        return df
    out = GeoFrame(df, geometry)
    out = out.with_geometry(GeoColumn(out.df[geometry], kind, geometry))
    if force_2d:
        g = out.geometry
        if g.type.typed:
            flat = native.map_coords(g.column, g.type.kind, lambda p: native.point(p["x"], p["y"]))
            out = out.with_geometry(GeoColumn(flat, GeoType(g.type.kind, "xy", g.type.crs), geometry))
        else:
            out = out.with_geometry(GeoColumn(kernels.column(lambda x: kernels.map_positions(x, lambda p: p[:2]), "wkb", g.column, g.type.kind), g.type, geometry))
    return out


def write_geojson(frame: GeoFrame, path: str) -> None:
    """One feature a line, as text files in the folder `path`."""
    import json

    g = frame.geometry
    shape = kernels.column(lambda x: json.dumps(codec.to_geojson(x)), "string", g.column, g.type.kind)
    rest = [c for c in frame.df.columns if c != frame.geometry_name]
    props = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    frame.df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit("}")).alias("value")).write.text(path)
