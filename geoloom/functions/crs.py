"""Closed-form projections: identity, EPSG:4326 <-> 3857, EPSG:4326 <-> UTM (326zz, 327zz).

x is longitude or easting, y latitude or northing. Only vertices are transformed; segments are straight in
the given projection. Other pairs raise CrsError (or use pyproj where it is installed).
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import codec
from ..errors import CrsError
from . import kernels, native

RADIUS = 6378137.0
SUPPORTED = "EPSG:4326 to and from EPSG:3857 and EPSG:326zz or 327zz (UTM), and any CRS to itself"
# Krueger series in n = f / (2 - f), to the fourth order.
_N = kernels.FLAT / (2 - kernels.FLAT)
_RECT = kernels.A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_E = math.sqrt(kernels.FLAT * (2 - kernels.FLAT))


def code(crs) -> str:
    """Authority code of a CRS given as text or as an object with to_json."""
    if hasattr(crs, "to_json"):
        crs = crs.to_json()
    if not isinstance(crs, str):
        raise CrsError(f"a CRS is text or has to_json, not {type(crs).__name__}")
    text = crs.strip()
    if text.startswith("{"):
        ident = json.loads(text).get("id") or {}
        text = f"{ident.get('authority', '')}:{ident.get('code', '')}"
    found = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', text)
    text = f"EPSG:{found[-1]}" if found else text.upper()
    return "EPSG:4326" if text in ("OGC:CRS84", "WGS84") else text


def _zone(c: str):
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", c)
    return (int(m[2]) * 6 - 183, 10_000_000.0 if m[1] == "7" else 0.0) if m and 1 <= int(m[2]) <= 60 else None


class _Cols:
    """The functions the formulas need, for columns or for numpy arrays; pair names two values so they are computed once."""

    @staticmethod
    def pair(a, b, body):
        out = native.let(F.struct(a.alias("u"), b.alias("v")), lambda s: F.struct(*[c.alias(n) for c, n in zip(body(s["u"], s["v"]), "xy", strict=True)]))
        return out["x"], out["y"]

    sin, cos, tan, atan, sinh, cosh, log, exp, sqrt, atan2, asinh, atanh, tanh = F.sin, F.cos, F.tan, F.atan, F.sinh, F.cosh, F.log, F.exp, F.sqrt, F.atan2, F.asinh, F.atanh, F.tanh


class _Arrays:
    @staticmethod
    def pair(a, b, body):
        return body(a, b)

    sin, cos, tan, atan, sinh, cosh, log, exp, sqrt, atan2, asinh, atanh, tanh = np.sin, np.cos, np.tan, np.arctan, np.sinh, np.cosh, np.log, np.exp, np.sqrt, np.arctan2, np.arcsinh, np.arctanh, np.tanh


def _steps(source: str, target: str):
    """Function (library, x, y) -> (x, y)."""
    if source == target:
        return lambda m, x, y: (x, y)
    deg = math.pi / 180
    if (source, target) == ("EPSG:4326", "EPSG:3857"):
        return lambda m, x, y: (x * deg * RADIUS, m.log(m.tan(math.pi / 4 + y * deg / 2)) * RADIUS)
    if (source, target) == ("EPSG:3857", "EPSG:4326"):
        return lambda m, x, y: (x / RADIUS / deg, (2 * m.atan(m.exp(y / RADIUS)) - math.pi / 2) / deg)
    if source == "EPSG:4326" and _zone(target):
        meridian, north = _zone(target)

        def forward(m, x, y):
            s, lam = m.sin(y * deg), (x - meridian) * deg
            t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))

            def grid(xi, eta):
                e, n = eta, xi
                for j, a in enumerate(_ALPHA, 1):
                    e = e + m.cos(2 * j * xi) * m.sinh(2 * j * eta) * a
                    n = n + m.sin(2 * j * xi) * m.cosh(2 * j * eta) * a
                return e * (0.9996 * _RECT) + 500000.0, n * (0.9996 * _RECT) + north

            return m.pair(m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam))), grid)

        return forward
    if target == "EPSG:4326" and _zone(source):
        meridian, north = _zone(source)

        def back(m, x, y):
            def sphere(xi, eta):
                p, q = xi, eta
                for j, b in enumerate(_BETA, 1):
                    p = p - m.sin(2 * j * xi) * m.cosh(2 * j * eta) * b
                    q = q - m.cos(2 * j * xi) * m.sinh(2 * j * eta) * b
                return m.pair(p, q, angles)

            def angles(p, q):
                psi = m.asinh(m.sin(p) / m.sqrt(m.sinh(q) * m.sinh(q) + m.cos(p) * m.cos(p)))
                return m.pair(m.atan2(m.sinh(q), m.cos(p)) / deg + meridian, psi, latitude)

            def latitude(lon, psi):
                lat = psi  # from the conformal latitude by fixed-point steps, each of which shrinks the error by e^2
                for _ in range(7):
                    lat = psi + _E * m.atanh(_E * m.tanh(lat))
                return lon, m.atan(m.sinh(lat)) / deg

            return m.pair((y - north) / (0.9996 * _RECT), (x - 500000.0) / (0.9996 * _RECT), sphere)

        return back
    return None


def transform(g: Column, kind: str, source, target, dim: str = "xy") -> Column:
    """g with vertices transformed from one CRS to the other (typed and WKB columns)."""
    a, b = code(source), code(target)
    f = _steps(a, b)
    if f is None and a != "EPSG:4326" and b != "EPSG:4326" and _steps(a, "EPSG:4326") and _steps("EPSG:4326", b):
        one, two = _steps(a, "EPSG:4326"), _steps("EPSG:4326", b)
        f = lambda m, x, y: two(m, *one(m, x, y))
    if f is None:
        try:
            import pyproj
        except ImportError:
            raise CrsError(f"no transformation from {a} to {b}; supported: {SUPPORTED}") from None
        t = pyproj.Transformer.from_crs(source, target, always_xy=True)
        return kernels.column(lambda geom: kernels.map_positions(geom, lambda p: (*t.transform(p[0], p[1]), *p[2:])), "wkb", g, kind)
    if kind == "wkb":
        def moved(p):
            x, y = f(_Arrays, np.float64(p[0]), np.float64(p[1]))
            return (float(x), float(y), *p[2:])

        return kernels.column(lambda geom: kernels.map_positions(geom, moved), "wkb", g, kind)

    def pos(p):
        x, y = f(_Cols, p["x"], p["y"])
        return native._moved(p, dim, x, y)

    return native.map_coords(g, kind, pos)


def decode(g: Column, kind: str) -> Column:
    """Typed column from WKB of that kind; other kinds in the column raise."""
    from ..types import GeoType

    shape = GeoType(kind).data_type().simpleString()
    as_json = kernels.column(lambda geom: _json(geom, kind), "string", g, "wkb")
    return F.from_json(as_json, f"struct<g:{shape}>")["g"]


def _json(geom, kind: str) -> str:
    from ..errors import ComputeError

    if geom[0] != kind:
        raise ComputeError(f"expected {kind}, found {geom[0]}")

    def walk(v):
        return [walk(x) for x in v] if isinstance(v, list) else None if v is None else {"x": v[0], "y": v[1]}

    return json.dumps({"g": walk(geom[1])})


def encode(g: Column, kind: str) -> Column:
    """WKB of a typed or WKT column."""
    return g if kind == "wkb" else kernels.column(lambda geom: geom, "wkb", g, kind)


def as_text(g: Column, kind: str) -> Column:
    return kernels.column(codec.to_wkt, "string", g, kind)
