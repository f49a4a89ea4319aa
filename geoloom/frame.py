"""GeoFrame and GeoColumn: a DataFrame with a geometry column, and the `.geo` operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

from .errors import CrsError, GeometryTypeError, InvalidOperationError, NotFoundError, ShapeError
from .functions import crs as crs_functions
from .functions import kernels, native, ragged
from .types import GeoType

PLAIN = GeoType("wkb")


class GeoColumn:
    """A geometry expression with its type, bound to the frame it comes from."""

    def __init__(self, column: Column, type: GeoType, name: str = "geometry", frame: GeoFrame | None = None):
        self.column, self.type, self.name, self.frame = column, type, name, frame

    @property
    def tagged(self) -> Column:
        """The expression under its name, with the type in the metadata."""
        return self.column.alias(self.name, metadata=self.type.metadata())

    @property
    def crs(self) -> str | None:
        return self.type.crs

    def set_crs(self, crs: str) -> GeoColumn:
        return GeoColumn(self.column, self.type.with_crs(crs_functions.code(crs)), self.name, self.frame)

    def to_crs(self, from_crs=None, to_crs=None) -> GeoColumn:
        """Vertices transformed; from_crs defaults to the column's own."""
        source = from_crs if from_crs is not None else self.type.crs
        if source is None or to_crs is None:
            raise CrsError("to_crs needs both ends: the column has no CRS of its own or none is given")
        g = crs_functions.transform(self.column, self.type.kind, source, to_crs, self.type.dim)
        return GeoColumn(g, self.type.with_crs(crs_functions.code(to_crs)), self.name, self.frame)

    @property
    def geo(self) -> GeoOps:
        return GeoOps(self)

    @property
    def geos(self) -> GeosOps:
        return GeosOps(self)


class GeosOps:
    """A namespace without operators."""

    def __init__(self, column: GeoColumn):
        self.series = column


class GeoOps:
    """The geometry operators of a column: measures are plain columns, constructions are GeoColumns."""

    def __init__(self, column: GeoColumn):
        self.series = column

    def _out(self, column: Column, kind: str | None = None) -> GeoColumn:
        t = self.series.type
        return GeoColumn(column, t if kind is None else GeoType(kind, "xy", t.crs, t.edges), self.series.name, self.series.frame)

    def _measure(self, name: str, returns: str = "double") -> Column:
        s = self.series
        if s.type.typed:
            return getattr(native, name)(s.column, s.type.kind)
        if s.type.kind == "wkb":
            return ragged.column(name, s.column)
        kernel = {"geom_type": kernels.title, "is_empty": _empty}.get(name) or getattr(kernels, name)
        return kernels.column(kernel, returns, s.column, s.type.kind)

    def _map(self, matrix, origin=None) -> GeoColumn:
        s = self.series
        if s.type.kind == "wkb":
            return self._out(ragged.affine(s.column, matrix, origin))
        return self._out(kernels.column(lambda g: kernels.affine(g, matrix, origin), "wkb", s.column, s.type.kind))

    def affine_transform(self, matrix) -> GeoColumn:
        s = self.series
        if len(matrix) != 6:
            raise InvalidOperationError("the affine matrix has 6 numbers: [a, b, d, e, xoff, yoff]")
        return self._out(native.affine(s.column, s.type.kind, list(matrix), s.type.dim)) if s.type.typed else self._map([float(m) for m in matrix])

    @property
    def area(self) -> Column:
        return self._measure("area")

    @property
    def centroid(self) -> GeoColumn:
        s = self.series
        return self._out(native.centroid(s.column, s.type.kind), "point") if s.type.typed else self._out(self._measure("centroid", "wkb"), "wkb")

    def convex_hull(self) -> GeoColumn:
        s = self.series
        return self._out(kernels.column(kernels.convex_hull, "wkb", s.column, s.type.kind), "wkb")

    def envelope(self) -> GeoColumn:
        s = self.series
        if s.type.typed:
            return self._out(native.envelope(s.column, s.type.kind), "point" if s.type.kind == "point" else "polygon")
        return self._out(self._measure("envelope", "wkb"), "wkb")

    def euclidean_length(self) -> Column:
        return self._measure("length")

    def exterior(self) -> GeoColumn:
        s = self.series
        return self._out(native.exterior(s.column, s.type.kind), "linestring") if s.type.typed else self._out(self._measure("exterior", "wkb"), "wkb")

    def geodesic_length(self, method: str = "geodesic") -> Column:
        s, m = self.series, kernels.method_name(method)
        if m == "haversine" and s.type.typed:
            return native.haversine_length(s.column, s.type.kind)
        if s.type.kind == "wkb":
            return ragged.geodesic(s.column, m)
        return kernels.geodesic_column(s.column, s.type.kind, m)

    @property
    def geom_type(self) -> Column:
        return self._measure("geom_type", "string")

    def is_empty(self) -> Column:
        return self._measure("is_empty", "boolean")

    is_geom_empty = is_empty

    def is_ring(self) -> Column:
        return self._measure("is_ring", "boolean")

    def _about(self, name: str, origin, matrix, *args) -> GeoColumn:
        s = self.series
        if isinstance(origin, str) and origin.lower() not in ("center", "centroid"):
            raise InvalidOperationError(f"Invalid argument {origin!r}: use center, centroid or a point")
        if s.type.typed:
            return self._out(getattr(native, name)(s.column, s.type.kind, *args, origin=origin, dim=s.type.dim))
        if isinstance(origin, dict):
            origin = (origin["x"], origin["y"])
        elif hasattr(origin, "x"):
            origin = (origin.x, origin.y)
        return self._map((*matrix, 0.0, 0.0), origin.lower() if isinstance(origin, str) else tuple(origin))

    def rotate(self, angle: float, origin="center") -> GeoColumn:
        import math

        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        return self._about("rotate", origin, (c, -s, s, c), angle)

    def scale(self, xfact: float = 1.0, yfact: float = 1.0, origin="center") -> GeoColumn:
        return self._about("scale", origin, (xfact, 0.0, 0.0, yfact), xfact, yfact)

    def skew(self, xs: float = 0.0, ys: float = 0.0, origin="center") -> GeoColumn:
        import math

        return self._about("skew", origin, (1.0, math.tan(math.radians(xs)), math.tan(math.radians(ys)), 1.0), xs, ys)

    geom_skew = skew

    def translate(self, xoff: float = 0.0, yoff: float = 0.0) -> GeoColumn:
        return self.affine_transform([1, 0, 0, 1, xoff, yoff])

    def distance(self, other: GeoColumn) -> Column:
        """Row by row within one frame; see GeoFrame.distance for two frames."""
        a, b = self.series, other
        if a.type.crs != b.type.crs and a.type.crs and b.type.crs:
            raise CrsError(f"distance between {a.type.crs} and {b.type.crs}")
        if a.type.kind == b.type.kind == "point":
            return native.point_distance(a.column, b.column)
        if a.type.kind == b.type.kind == "wkb":
            return ragged.distance(a.column, b.column)
        return kernels.column(kernels.distance, "double", a.column, a.type.kind, (b.column, b.type.kind))

    def _axis(self, i: int) -> Column:
        s = self.series
        if s.type.typed:
            return (native.x, native.y)[i](s.column, s.type.kind)
        if s.type.kind not in ("wkb", "wkt"):
            raise GeometryTypeError(f"x and y are defined for points, not for {s.type.kind}")
        if s.type.kind == "wkb":
            return ragged.column("xy"[i], s.column)
        return kernels.column(lambda g: kernels.only_point(g, i), "double", s.column, s.type.kind)

    @property
    def x(self) -> Column:
        return self._axis(0)

    @property
    def y(self) -> Column:
        return self._axis(1)

    def bounds(self) -> Column:
        s = self.series
        if not s.type.typed:
            raise GeometryTypeError("bounds needs a typed column; decode the WKB first")
        return native.bounds(s.column, s.type.kind)


def _empty(geom) -> bool:
    from . import codec

    return codec.empty(geom)


class GeoFrame:
    """A DataFrame and the name of its geometry column; DataFrame methods pass through."""

    def __init__(self, df: DataFrame, geometry: str = "geometry"):
        if geometry not in df.columns:
            raise NotFoundError(f"no column {geometry!r}; columns: {', '.join(df.columns)}")
        self.df, self.geometry_name = df, geometry

    @property
    def type(self) -> GeoType:
        return GeoType.from_field(self.df.schema[self.geometry_name]) or PLAIN

    @property
    def geometry(self) -> GeoColumn:
        return GeoColumn(self.df[self.geometry_name], self.type, self.geometry_name, self)

    def get_column(self, name: str) -> GeoColumn | Column:
        if name not in self.df.columns:
            raise NotFoundError(f"no column {name!r}")
        return self.geometry if name == self.geometry_name else self.df[name]

    @property
    def crs(self) -> str | None:
        return self.type.crs

    def with_geometry(self, geometry: GeoColumn) -> GeoFrame:
        """The frame with its geometry replaced (and re-tagged: computed columns lose metadata)."""
        tag = geometry.column.alias(self.geometry_name, metadata=geometry.type.metadata())
        return GeoFrame(self.df.select(*[tag if c == self.geometry_name else self.df[c] for c in self.df.columns]), self.geometry_name)

    def set_crs(self, crs: str) -> GeoFrame:
        return self.with_geometry(self.geometry.set_crs(crs))

    def to_crs(self, to_crs, from_crs=None) -> GeoFrame:
        return self.with_geometry(self.geometry.to_crs(from_crs, to_crs))

    def total_bounds(self) -> DataFrame:
        b = self.df.select(self.geometry.geo.bounds().alias("b"))
        return b.agg(*[f(f"b.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])

    def rename(self, old: str, new: str) -> GeoFrame:
        return GeoFrame(self.df.withColumnRenamed(old, new), new if old == self.geometry_name else self.geometry_name)

    def union(self, other: GeoFrame) -> GeoFrame:
        if self.crs != other.crs:
            raise CrsError(f"union of {self.crs} and {other.crs}")
        return GeoFrame(self.df.unionByName(other.df), self.geometry_name)

    def join(self, other: GeoFrame | DataFrame, on, how: str = "inner", suffix: str = "_right") -> GeoFrame:
        """Columns of the right side that clash with the left (other than keys) get the suffix."""
        right = other.df if isinstance(other, GeoFrame) else other
        keys = [on] if isinstance(on, str) else list(on)
        for c in set(right.columns) & set(self.df.columns) - set(keys):
            right = right.withColumnRenamed(c, c + suffix)
        return GeoFrame(self.df.join(right, keys, how), self.geometry_name)

    def join_asof(self, other: DataFrame, on: str, by: str | list[str] | None = None) -> DataFrame:
        """Each row with the last row of other at or before it."""
        df = asof(self.df, other, on, by)
        return GeoFrame(df, self.geometry_name)

    def distance(self, other: GeoFrame, key: str) -> DataFrame:
        """(key, distance) of rows aligned by a key that both frames hold once."""
        a = self.df.select(key, F.col(self.geometry_name).alias("_a"), F.lit(1).alias("_n"))
        b = other.df.select(key, F.col(other.geometry_name).alias("_b"), F.lit(1).alias("_m"))
        both = a.join(b, key, "full")
        if not both.where("_n IS NULL OR _m IS NULL").isEmpty():
            raise ShapeError("frames with different keys are not aligned")
        return both.select(key, GeoColumn(F.col("_a"), self.type).geo.distance(GeoColumn(F.col("_b"), other.type)).alias("distance"))

    def frame_equal(self, other: GeoFrame | DataFrame) -> bool:
        """Whether both hold the same columns and the same rows, each as often, in any order; geometry types count too."""
        theirs = other.df if isinstance(other, GeoFrame) else other
        tags = lambda df: [(f.name, f.dataType.simpleString(), GeoType.from_field(f)) for f in df.schema.fields]
        if tags(self.df) != tags(theirs):
            return False
        return self.df.exceptAll(theirs).isEmpty() and theirs.exceptAll(self.df).isEmpty()

    def series_equal(self, other: GeoFrame) -> bool:
        """Whether the geometry columns hold the same geometries, each as often, whatever their names."""
        mine, theirs = (GeoFrame(f.df.select(F.col(f.geometry_name).alias("geometry", metadata=f.type.metadata()))) for f in (self, other))
        return mine.frame_equal(theirs)

    def __getattr__(self, name: str):
        if name.startswith("_") or name == "df":
            raise AttributeError(name)
        got = getattr(self.df, name)
        if not callable(got):
            return got

        def call(*args, **kwargs):
            out = got(*args, **kwargs)
            return GeoFrame(out, self.geometry_name) if isinstance(out, DataFrame) and self.geometry_name in out.columns else out

        return call


SLICES = 64


def asof(left: DataFrame, right: DataFrame, on: str, by: str | list[str] | None = None) -> DataFrame:
    """As-of join by one union and one window: the last right row at or before the left row.

    Rows are ordered by `on` within `by`; of right rows with equal `on`, the largest row wins. Right
    columns other than keys get the suffix `_right` where they clash, and are null without a match.
    Without `by`, numbers and times are ordered in SLICES slices; other types in one task.
    """
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    values = [c for c in right.columns if c not in keys]
    names = {c: c + "_right" if c in left.columns else c for c in values}
    packed = right.select(*keys, F.col(on).alias("_on"), F.lit(0).alias("_side"), F.struct(*values).alias("_r"))
    own = left.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = packed.withColumn("_l", F.lit(None).cast(own.schema["_l"].dataType)).unionByName(own.withColumn("_r", F.lit(None).cast(packed.schema["_r"].dataType)))
    slot = [F.col(k) for k in keys]
    carried = None
    if not keys and isinstance(left.schema[on].dataType, (NumericType, TimestampType, TimestampNTZType, DateType)):
        # Without keys, slices of the order are windows of their own; each starts with the last right row before it.
        number = F.col("_on").cast("timestamp").cast("double") if isinstance(left.schema[on].dataType, (DateType, TimestampNTZType)) else F.col("_on").cast("double")
        cuts = sorted(set(both.select(number.alias("x")).approxQuantile("x", [i / SLICES for i in range(1, SLICES)], 0.5 / SLICES)))
        both = both.withColumn("_slot", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= number)))
        last = both.where("_side = 0").groupBy("_slot").agg(F.max(F.struct("_on", "_r")).alias("_last"))
        slots = both.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_slot")).join(last, "_slot", "left").coalesce(1)
        carried = slots.select(F.col("_slot"), F.last("_last._r", ignorenulls=True).over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        slot = [F.col("_slot")]
    w = Window.partitionBy(*slot).orderBy("_on", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if carried is not None:
        hit = hit.join(F.broadcast(carried), "_slot").withColumn("_m", F.coalesce("_m", "_before"))
    return hit.select("_l.*", *[F.col(f"_m.{c}").alias(n) for c, n in names.items()])
