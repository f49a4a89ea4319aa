"""Exchange with Arrow and pandas; geometry types travel in field metadata both ways."""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import _check_arrow_table_timestamps_localize, from_arrow_schema, from_arrow_type, to_arrow_schema

from .. import codec
from ..errors import InvalidOperationError, NotFoundError
from ..frame import GeoColumn, GeoFrame
from ..functions import crs as codecs
from ..types import GeoType, from_arrow_field

PART_BYTES = 16 << 20  # of rows in one Arrow file
BATCH_ROWS = 10_000
_WIDER = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.binary_view(): pa.binary(), pa.string_view(): pa.string()}


def _accepted(table: pa.Table) -> pa.Table:
    """Types that Spark rejects, widened or cast."""
    for i, f in enumerate(table.schema):
        if f.type in _WIDER:
            table = table.set_column(i, pa.field(f.name, _WIDER[f.type], f.nullable, f.metadata), table.column(i).cast(_WIDER[f.type]))
    return table


def _separated(col, depth: int, dim: str):
    """Interleaved positions (arrays) as structs."""
    if depth == 0:
        return F.when(col.isNotNull(), F.struct(*[F.get(col, F.lit(i)).alias(c) for i, c in enumerate(dim)]))
    return F.transform(col, lambda x: _separated(x, depth - 1, dim))


def from_arrow(spark: SparkSession, data: pa.Table | pa.Array | pa.ChunkedArray, field: pa.Field | None = None) -> GeoFrame | DataFrame:
    """Table to frame (a GeoFrame if a column is tagged or called geometry); an array to (index, geometry)."""
    if not isinstance(data, pa.Table):
        f = field or pa.field("geometry", data.type)
        data = pa.table([pa.array(range(len(data)), pa.int64()), data], pa.schema([pa.field("index", pa.int64()), f.with_name(f.name or "geometry")]))
    table = _accepted(data)
    return _tagged_frame(spark.createDataFrame(table), table.schema)


def _tagged_frame(df: DataFrame, fields: pa.Schema) -> GeoFrame | DataFrame:
    """A frame of these Arrow fields with its geometry columns tagged, positions as structs."""
    from ..types import DEPTH

    types = {f.name: from_arrow_field(f) for f in fields}
    cols = []
    for c in df.columns:
        t = types[c]
        if t is None:
            cols.append(F.col(c))
        else:
            col = _separated(F.col(c), DEPTH[t.kind], t.dim) if t.typed and t.layout == "interleaved" else F.col(c)
            cols.append(col.alias(c, metadata=t.metadata()))
    df = df.select(*cols)
    name = "geometry" if "geometry" in df.columns else next((c for c, t in types.items() if t), None)
    return GeoFrame(df, name) if name else df


def _interleaved(array: pa.Array, depth: int, dim: str) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if depth:
        inner = _interleaved(array.values, depth - 1, dim)
        return pa.ListArray.from_arrays(array.offsets, inner, mask=array.is_null() if array.null_count and not array.offset else None)
    flat = pc.list_flatten(pa.array([[p.get(c) if p else None for c in dim] for p in array.to_pylist()], pa.list_(pa.float64())))
    return pa.FixedSizeListArray.from_arrays(flat, len(dim))


def to_arrow(frame: GeoFrame | DataFrame) -> pa.Table:
    """Arrow table with extension metadata on tagged columns; interleaved layouts are restored."""
    df = frame.df if isinstance(frame, GeoFrame) else frame
    return _tagged_table(df.toArrow(), [GeoType.from_field(f) for f in df.schema.fields])


def _tagged_table(table: pa.Table, types: list[GeoType | None]) -> pa.Table:
    from ..types import DEPTH

    for i, t in enumerate(types):
        if t is not None:
            col = table.column(i)
            if t.typed and t.layout == "interleaved":
                col = _interleaved(col, DEPTH[t.kind], t.dim)
            table = table.set_column(i, pa.field(table.schema.names[i], col.type, True, t.metadata()), col)
    return table


_MAGIC = b"ARROW1"  # ends an IPC file


def _file_bytes(tables: list[pa.Table], schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, schema) as w:
        for t in tables:
            w.write_table(t)
    return sink.getvalue().to_pybytes()


def write_arrow(frame: GeoFrame | DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """Arrow IPC files of about part_bytes in the folder `path`, written by the tasks; one of them has the fields and no rows.

    Spark's text writer puts one value in a file and its line separator after it, here the magic that
    ends each IPC file.
    """
    df = frame.df if isinstance(frame, GeoFrame) else frame
    types = [GeoType.from_field(f) for f in df.schema.fields]
    head = to_arrow(df.limit(0))
    schema = head.schema

    def run(batches):
        held, size = [], 0
        for b in batches:
            t = _tagged_table(pa.Table.from_batches([b]), types).cast(schema)
            if held and size + t.nbytes > part_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([_file_bytes(held, schema)[: -len(_MAGIC)]], pa.binary())], ["content"])
                held, size = [], 0
            held.append(t)
            size += t.nbytes
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_file_bytes(held, schema)[: -len(_MAGIC)]], pa.binary())], ["content"])

    empty = df.sparkSession.createDataFrame([(bytearray(_file_bytes([], schema)[: -len(_MAGIC)]),)], "content binary")
    files = empty.unionByName(df.mapInArrow(run, "content binary"))
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", _MAGIC.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_arrow(spark: SparkSession, path: str) -> GeoFrame | DataFrame:
    """IPC files (one, or a folder of them), each opened by the task that reads it; the driver sees the fields alone."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    size = files.select(F.substring("content", 9, 8).alias("size")).first()
    if size is None:
        raise NotFoundError(f"no file at {path}")
    mark, length = struct.unpack("<Ii", bytes(size["size"]))
    head = files.select(F.substring("content", 9, 8 + (length if mark == 0xFFFFFFFF else mark)).alias("head")).first()["head"]
    fields = _accepted(pa.ipc.read_schema(pa.py_buffer(bytes(head))).empty_table()).schema
    ntz = spark.conf.get("spark.sql.timestampType") == "TIMESTAMP_NTZ"
    zone = spark.conf.get("spark.sql.session.timeZone")
    schema = from_arrow_schema(fields, prefer_timestamp_ntz=ntz)
    plain = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                found = pa.ipc.open_file(content.as_buffer())
                for i in range(found.num_record_batches):
                    t = _accepted(pa.Table.from_batches([found.get_batch(i)]))
                    t = _check_arrow_table_timestamps_localize(t, schema, True, zone)
                    yield from t.select(plain.names).cast(plain).to_batches(BATCH_ROWS)

    return _tagged_frame(files.select("content").mapInArrow(run, schema), fields)


def from_pandas(spark: SparkSession, data) -> DataFrame:
    return spark.createDataFrame(data)


def from_geopandas(spark: SparkSession, data, force_wkb: bool = True) -> GeoFrame | DataFrame:
    """A geopandas series or frame (anything with to_wkb) as WKB, or as a typed column if it holds one kind and force_wkb is off; plain pandas as a plain frame."""
    import pandas as pd

    if hasattr(data, "to_wkb") and isinstance(data, pd.Series):
        data, name = pd.DataFrame({"index": range(len(data)), "geometry": data.to_wkb()}), "geometry"
    elif hasattr(data, "to_wkb"):
        name = data.geometry.name
        data = pd.DataFrame(data.to_wkb())
    elif isinstance(data, pd.DataFrame):
        return from_pandas(spark, data)
    else:
        raise InvalidOperationError(f"expected a geopandas or pandas object, found {type(data).__name__}")
    t = GeoType("wkb")
    df = spark.createDataFrame(data)
    df = df.withColumn(name, F.col(name).cast("binary")).select(*[F.col(c).alias(c, metadata=t.metadata()) if c == name else F.col(c) for c in df.columns])
    kinds = {codec.from_wkb(bytes(b))[0] for b in data[name] if b is not None}
    if not force_wkb and len(kinds) == 1 and next(iter(kinds)) != "geometrycollection":
        kind = kinds.pop()
        return GeoFrame(df, name).with_geometry(GeoColumn(codecs.decode(F.col(name), kind), GeoType(kind), name))
    return GeoFrame(df, name)


def _encoded(frame: GeoFrame) -> DataFrame:
    """The frame with its geometry last, as WKB."""
    g = frame.geometry
    return frame.df.select(*[c for c in frame.df.columns if c != frame.geometry_name], codecs.encode(g.column, g.type.kind).alias("geometry"))


def _geometries(out, crs: str | None):
    """A pandas frame with geopandas geometries where it is installed, else as it is."""
    try:
        import geopandas
    except ImportError:
        return out
    return geopandas.GeoDataFrame(out.drop(columns="geometry"), geometry=geopandas.GeoSeries.from_wkb(out["geometry"]), crs=crs)


def to_geopandas(frame: GeoFrame):
    """pandas frame with the geometry last: geopandas geometries where it is installed, else WKB. The driver holds all of it."""
    return _geometries(_encoded(frame).toPandas(), frame.crs)


def map_geopandas(frame: GeoFrame, f) -> GeoFrame:
    """f over the frame's pandas (geopandas) frames, a batch at a time where the rows are; f keeps the columns. The geometry comes back last, as WKB."""
    df, crs = _encoded(frame), frame.crs

    def run(parts):
        import pandas as pd

        for part in parts:
            out = f(_geometries(part, crs))
            yield pd.DataFrame(out.to_wkb()) if hasattr(out, "to_wkb") else out

    made = df.mapInPandas(run, df.schema)
    return GeoFrame(made.withMetadata("geometry", GeoType("wkb", crs=crs).metadata()), "geometry")


def from_xy(df: DataFrame, x: str, y: str, name: str = "geometry", crs: str | None = None) -> GeoFrame:
    """Points from two columns."""
    t = GeoType("point", crs=crs)
    return GeoFrame(df.withColumn(name, F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).select(*[c for c in df.columns if c != name], F.col(name).alias(name, metadata=t.metadata())), name)


def from_data(spark: SparkSession, data, columns: list[str] | None = None, orient: str | None = None, geometry: str = "geometry", kind: str = "wkb", crs: str | None = None) -> GeoFrame:
    """A frame from a dict of columns, or from a list of rows (orient "row") or of columns (orient "col") with their names.

    Geometries of a typed kind are nested tuples of coordinates; of kind "wkb" they are bytes.
    """
    if orient not in (None, "row", "col"):
        raise InvalidOperationError(f"orient is 'row' or 'col', not {orient!r}")
    if isinstance(data, dict):
        columns, data = columns or list(data), list(zip(*data.values(), strict=True))
    elif orient == "col":
        data = list(zip(*data, strict=True))
    if not columns or geometry not in columns:
        raise InvalidOperationError(f"columns must name {geometry!r}")
    t = GeoType(kind, crs=crs)
    rest = [i for i, c in enumerate(columns) if c != geometry]
    at = columns.index(geometry)
    plain = pa.table({columns[i]: [r[i] for r in data] for i in rest}) if rest else None
    schema = T.StructType([*(T.StructField(columns[i], from_arrow_type(plain.schema.field(columns[i]).type)) for i in rest), t.to_field(geometry)])
    df = spark.createDataFrame([tuple([*(r[i] for i in rest), r[at]]) for r in data], schema)
    return GeoFrame(df.select(*columns), geometry)
