"""WKB and WKT codecs on a plain form: (kind, coords), coords nested as in the typed columns.

A collection's coords are a list of (kind, coords). Positions are tuples of 2 to 4 floats. Byte
orders, ISO (+1000, +2000, +3000) and EWKB (flag) codes are read; little-endian ISO is written.
"""

from __future__ import annotations

import math
import re
import struct

from .errors import ComputeError
from .types import TITLES

CODES = {"point": 1, "linestring": 2, "polygon": 3, "multipoint": 4, "multilinestring": 5, "multipolygon": 6, "geometrycollection": 7}
KIND_OF = {v: k for k, v in CODES.items()}
MEMBER = {"multipoint": "point", "multilinestring": "linestring", "multipolygon": "polygon"}
_DIM = {0: "xy", 1: "xyz", 2: "xym", 3: "xyzm"}


def empty(geom) -> bool:
    kind, c = geom
    if kind == "point":
        return c is None or all(math.isnan(v) for v in c[:2])
    if kind == "geometrycollection":
        return all(empty(g) for g in c)
    if kind in ("polygon", "multilinestring"):
        return all(not r for r in c)
    if kind == "multipolygon":
        return all(not r for p in c for r in p)
    if kind == "multipoint":
        return all(empty(("point", p)) for p in c)
    return not c


def width(geom, default: int = 2) -> int:
    """Coordinates of a position."""
    kind, c = geom
    if kind == "geometrycollection":
        return max([width(g, default) for g in c], default=default)
    while c and isinstance(c, list):
        c = c[0]
    return len(c) if isinstance(c, tuple) else default


def to_wkb(geom, dim: str | None = None) -> bytes:
    n = len(dim) if dim else width(geom)
    dim = dim or {2: "xy", 3: "xyz", 4: "xyzm"}[n]
    flag = 1000 * {v: k for k, v in _DIM.items()}[dim]

    def seq(points) -> bytes:
        return struct.pack("<I", len(points)) + b"".join(struct.pack(f"<{n}d", *p) for p in points)

    def one(kind, c) -> bytes:
        head = struct.pack("<BI", 1, CODES[kind] + flag)
        if kind == "point":
            return head + struct.pack(f"<{n}d", *(c if c is not None else (math.nan,) * n))
        if kind == "linestring":
            return head + seq(c)
        if kind == "polygon":
            return head + struct.pack("<I", len(c)) + b"".join(map(seq, c))
        parts = [one(MEMBER[kind], m) for m in c] if kind in MEMBER else [one(*m) for m in c]
        return head + struct.pack("<I", len(parts)) + b"".join(parts)

    return one(*geom)


def from_wkb(blob: bytes):
    """(kind, coords) of WKB; ComputeError if it is malformed or has bytes left over."""
    at = 0

    def take(fmt: str, order: str):
        nonlocal at
        try:
            out = struct.unpack_from(order + fmt, blob, at)
        except struct.error as e:
            raise ComputeError("WKB ends early") from e
        at += struct.calcsize(order + fmt)
        return out

    def one():
        nonlocal at
        if at >= len(blob) or blob[at] not in (0, 1):
            raise ComputeError("WKB has no byte order mark")
        order = "<" if blob[at] else ">"
        at += 1
        (code,) = take("I", order)
        z, m = bool(code & 0x80000000), bool(code & 0x40000000)
        if code & 0x20000000:
            take("I", order)
        code &= 0x0FFFFFFF
        iso, base = divmod(code, 1000)
        if base not in KIND_OF or iso > 3:
            raise ComputeError(f"unsupported WKB geometry code {code}")
        n = 2 + (z or iso in (1, 3)) + (m or iso in (2, 3))
        kind = KIND_OF[base]

        def seq():
            (k,) = take("I", order)
            if k * n * 8 > len(blob) - at:
                raise ComputeError("WKB ends early")
            flat = take(f"{k * n}d", order)
            return [tuple(flat[i : i + n]) for i in range(0, k * n, n)]

        if kind == "point":
            p = take(f"{n}d", order)
            return kind, None if all(math.isnan(v) for v in p) else p
        if kind == "linestring":
            return kind, seq()
        (k,) = take("I", order)
        if kind == "polygon":
            return kind, [seq() for _ in range(k)]
        parts = [one() for _ in range(k)]
        return kind, [p[1] for p in parts] if kind in MEMBER else parts

    out = one()
    if at != len(blob):
        raise ComputeError(f"{len(blob) - at} bytes after the WKB geometry")
    return out


def _num(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def to_wkt(geom, dim: str | None = None) -> str:
    n = len(dim) if dim else width(geom)
    tag = {"xy": "", "xyz": " Z", "xym": " M", "xyzm": " ZM"}[dim or {2: "xy", 3: "xyz", 4: "xyzm"}[n]]

    def body(kind, c) -> str:
        pos = lambda p: " ".join(map(_num, p))
        line = lambda l: "(" + ", ".join(map(pos, l)) + ")"
        poly = lambda rs: "(" + ", ".join(map(line, rs)) + ")"
        return {"point": lambda: f"({pos(c)})", "linestring": lambda: line(c), "multipoint": lambda: "(" + ", ".join("EMPTY" if p is None else f"({pos(p)})" for p in c) + ")", "polygon": lambda: poly(c), "multilinestring": lambda: poly(c), "multipolygon": lambda: "(" + ", ".join(map(poly, c)) + ")"}[kind]()

    def one(kind, c) -> str:
        if kind == "geometrycollection":
            return "GEOMETRYCOLLECTION" + tag + (" (" + ", ".join(one(*g) for g in c) + ")" if c else " EMPTY")
        return kind.upper() + tag + (" EMPTY" if (c is None or c == []) else " " + body(kind, c))

    return one(*geom)


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def from_wkt(text: str):
    at = 0

    def peek():
        m = _TOKEN.match(text, at)
        return m[1] if m else None

    def take(want: str | None = None):
        nonlocal at
        m = _TOKEN.match(text, at)
        if not m or (want and m[1] != want):
            raise ComputeError(f"WKT: expected {want or 'a token'} at {at}")
        at = m.end()
        return m[1]

    def listed(item):
        take("(")
        out = [item()]
        while peek() == ",":
            take(",")
            out.append(item())
        take(")")
        return out

    def pos():
        out = []
        while peek() not in (",", ")", None):
            try:
                out.append(float(take()))
            except ValueError as e:
                raise ComputeError(f"WKT: no number at {at}") from e
        return tuple(out)

    def point():
        if peek() == "(":
            take("(")
            p = pos()
            take(")")
            return p
        if (peek() or "").upper() == "EMPTY":
            take()
            return None
        return pos()

    def one():
        kind = take().lower()
        if kind not in CODES:
            raise ComputeError(f"WKT: unknown geometry {kind}")
        if (peek() or "").upper() in ("Z", "M", "ZM"):
            take()
        if (peek() or "").upper() == "EMPTY":
            take()
            return kind, None if kind == "point" else []
        line = lambda: listed(pos)
        poly = lambda: listed(line)
        return kind, {"point": point, "linestring": line, "multipoint": lambda: listed(point), "polygon": poly, "multilinestring": poly, "multipolygon": lambda: listed(poly), "geometrycollection": lambda: listed(one)}[kind]()

    out = one()
    if text[at:].strip():
        raise ComputeError("WKT: text after the geometry")
    return out


def from_storage(kind: str, value):
    """Plain form of a typed column's value (dicts or rows of coordinates)."""
    def pos(p):
        t = tuple(p.values()) if isinstance(p, dict) else tuple(p)
        return None if all(v is None or math.isnan(v) for v in t[:2]) else t

    def walk(v):
        if v is None:
            return []
        return [walk(x) if isinstance(x, list) else pos(x) for x in v]

    if kind == "wkb":
        return from_wkb(bytes(value))
    if kind == "wkt":
        return from_wkt(value)
    return kind, pos(value) if kind == "point" else walk(value)


def to_geojson(geom) -> dict:
    kind, c = geom
    if kind == "geometrycollection":
        return {"type": "GeometryCollection", "geometries": [to_geojson(g) for g in c]}
    return {"type": TITLES[kind], "coordinates": c if c is not None else []}


def from_geojson(obj: dict):
    kind = obj["type"].lower()
    if kind == "geometrycollection":
        return kind, [from_geojson(g) for g in obj["geometries"]]
    if kind not in CODES:
        raise ComputeError(f"GeoJSON: unknown geometry {obj['type']}")

    def walk(v):
        return tuple(map(float, v)) if v and not isinstance(v[0], list) else [walk(x) for x in v]

    c = obj.get("coordinates") or []
    return kind, (walk(c) if c else None) if kind == "point" else walk(c)
