"""Numpy kernels on the codec's plain form, and Arrow-batched functions over WKB or typed columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import codec
from ..errors import ComputeError, InvalidOperationError
from ..types import TITLES

A, INV_F = 6378137.0, 298.257223563  # WGS84
FLAT = 1 / INV_F
B = A * (1 - FLAT)


# ---- structure ---------------------------------------------------------------------------------
def leaves(geom):
    """Simple members: (point|linestring|polygon, coords), empties left out."""
    kind, c = geom
    if kind == "geometrycollection":
        for g in c:
            yield from leaves(g)
    elif kind in codec.MEMBER:
        for m in c:
            yield from leaves((codec.MEMBER[kind], m))
    elif not codec.empty(geom):
        yield kind, [r for r in c if r] if kind == "polygon" else c


def positions(geom) -> np.ndarray:
    out = []
    for kind, c in leaves(geom):
        out += [c] if kind == "point" else c if kind == "linestring" else [p for r in c for p in r]
    return np.array([p[:2] for p in out], float).reshape(-1, 2)


def map_positions(geom, f):
    """geom with f applied to every position (tuple to tuple)."""
    kind, c = geom
    if kind == "geometrycollection":
        return kind, [map_positions(g, f) for g in c]

    def walk(v):
        return [walk(x) for x in v] if isinstance(v, list) else None if v is None else f(v)

    return kind, walk(c)


# ---- measures ----------------------------------------------------------------------------------
def _cross(r: np.ndarray) -> np.ndarray:
    d = r - r[0]
    return d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]


def _xy(line) -> np.ndarray:
    return np.array([p[:2] for p in line], float)


def area(geom) -> float:
    out = 0.0
    for kind, c in leaves(geom):
        if kind == "polygon":
            a = [abs(_cross(_xy(r)).sum()) / 2 for r in c]
            out += a[0] - sum(a[1:])
    return out


def _chains(geom):
    for kind, c in leaves(geom):
        yield from [c] if kind == "linestring" else c if kind == "polygon" else []


def length(geom) -> float:
    return float(sum(np.hypot(*np.diff(_xy(r), axis=0).T).sum() for r in _chains(geom) if len(r) > 1))


def centroid(geom):
    w, m = 0.0, np.zeros(2)
    for kind, c in leaves(geom):
        if kind == "polygon":
            for i, r in enumerate(c):
                r = _xy(r)
                x = _cross(r)
                a = x.sum()
                if a:
                    d = r - r[0]
                    k = abs(a) * (1 if i == 0 else -1)
                    m += k * (r[0] + ((d[:-1] + d[1:]) * x[:, None]).sum(axis=0) / (3 * a))
                    w += k
    if not w:
        for r in _chains(geom):
            r = _xy(r)
            s = np.hypot(*np.diff(r, axis=0).T) if len(r) > 1 else np.zeros(0)
            w += s.sum()
            m += (s[:, None] * (r[:-1] + r[1:]) / 2).sum(axis=0)
    if not w:
        p = positions(geom)
        return ("point", tuple(p.mean(axis=0).tolist())) if len(p) else None
    return "point", tuple((m / w).tolist())


def bounds(geom):
    p = positions(geom)
    return (*p.min(axis=0).tolist(), *p.max(axis=0).tolist()) if len(p) else None


def envelope(geom):
    b = bounds(geom)
    if b is None:
        return None
    if geom[0] == "point":
        return geom
    x0, y0, x1, y1 = b
    return "polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def convex_hull(geom):
    """Andrew's monotone chain: counter-clockwise from the lowest (x, y), without collinear vertices."""
    p = sorted({tuple(v) for v in positions(geom).tolist()})
    if len(p) < 2:
        return ("point", p[0]) if p else None

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    low, high = half(p), half(reversed(p))
    ring = low[:-1] + high
    return ("linestring", [p[0], p[-1]]) if len(ring) < 4 else ("polygon", [ring])


def is_ring(geom) -> bool:
    kind, c = geom
    return kind == "linestring" and bool(c) and tuple(c[0][:2]) == tuple(c[-1][:2])


def exterior(geom):
    return ("linestring", geom[1][0]) if geom[0] == "polygon" and geom[1] else None


# ---- distance ----------------------------------------------------------------------------------
def _edges(geom) -> tuple[np.ndarray, np.ndarray]:
    """Segments (points are segments of no length)."""
    a, b = [], []
    for kind, c in leaves(geom):
        for r in [[c]] if kind == "point" else [c] if kind == "linestring" else c:
            r = _xy(r)
            a.append(r[:-1] if len(r) > 1 else r)
            b.append(r[1:] if len(r) > 1 else r)
    return np.concatenate(a), np.concatenate(b)


def _to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    d = b - a
    n = (d * d).sum(axis=1)
    t = np.clip(((p[:, None] - a) * d).sum(axis=2) / np.where(n > 0, n, 1), 0, 1)
    return float(np.sqrt(((p[:, None] - (a + t[:, :, None] * d)) ** 2).sum(axis=2)).min())


def _crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    def side(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).any())


def _inside(p, rings) -> bool:
    """Even-odd over all rings, so a point in a hole is outside."""
    out = False
    for r in rings:
        r = _xy(r)
        x0, y0, x1, y1 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
        hit = (y0 > p[1]) != (y1 > p[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= bool((hit & (p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0)).sum() % 2)
    return out


def distance(g, h) -> float | None:
    """Least planar distance, 0 if they meet; None if either is empty."""
    left, right = list(leaves(g)), list(leaves(h))
    if not left or not right:
        return None
    for one, two in ((left, right), (right, left)):
        for kind, c in one:
            if kind == "polygon" and any(_inside((m if k == "point" else m[0] if k == "linestring" else m[0][0])[:2], c) for k, m in two):
                return 0.0
    (a, b), (c, d) = _edges(g), _edges(h)
    if _crossing(a, b, c, d):
        return 0.0
    return min(_to_segments(np.concatenate([a, b]), c, d), _to_segments(np.concatenate([c, d]), a, b))


# ---- geodesics ---------------------------------------------------------------------------------
def vincenty(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres on WGS84 by Vincenty's inverse iteration; ComputeError where it does not converge."""
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(np.asarray(v, float)))) for v in (lat1, lat2))
    ell = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    ell = (ell + np.pi) % (2 * np.pi) - np.pi
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = ell.copy()
    more = 2  # rounds after the tolerance is met, which leave only rounding errors
    for _ in range(200):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sig = np.arctan2(ss, cs)
        sa = np.divide(c1 * c2 * sl, ss, out=np.zeros_like(ss), where=ss > 0)
        ca = 1 - sa**2
        cm = cs - np.divide(2 * s1 * s2, ca, out=np.zeros_like(ca), where=ca > 1e-15)
        cm = np.where(ca > 1e-15, cm, 0.0)
        k = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
        new = ell + (1 - k) * FLAT * sa * (sig + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
        done = np.abs(new - lam) < 1e-12
        lam = new
        if done.all():
            more -= 1
            if more < 0:
                break
    else:
        raise ComputeError("Vincenty's iteration does not converge (nearly antipodal points); use geodesic")
    u = ca * (A**2 - B**2) / B**2
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    little = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    ds = little * ss * (cm + little / 4 * (cs * (2 * cm**2 - 1) - little / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    return np.where(ss > 0, B * big * (sig - ds), 0.0)


_NODE, _WEIGHT = np.polynomial.legendre.leggauss(24)


def _arc(al1, be1, be2, ep2):
    """(longitude difference, length / b) of the geodesic from reduced latitude be1 with azimuth al1 to be2 (Karney 2013, section 2)."""
    sb1, cb1, sb2, cb2 = np.sin(be1), np.maximum(np.cos(be1), 1e-200), np.sin(be2), np.maximum(np.cos(be2), 1e-200)
    sa1, ca1 = np.sin(al1), np.cos(al1)
    sa0 = sa1 * cb1
    ca0 = np.hypot(ca1, sa1 * sb1)
    ca2 = np.sqrt(np.maximum((ca1 * cb1) ** 2 + (cb2**2 - cb1**2), 0)) / cb2
    s1, s2 = np.arctan2(sb1, ca1 * cb1), np.arctan2(sb2, ca2 * cb2)
    w1, w2 = np.arctan2(sa0 * sb1, ca1 * cb1), np.arctan2(sa0 * sb2, ca2 * cb2)
    half, mid = (s2 - s1) / 2, (s2 + s1) / 2
    root = np.sqrt(1 + ep2 * (ca0[..., None] * np.sin(mid[..., None] + half[..., None] * _NODE)) ** 2)
    i1 = half * (root @ _WEIGHT)
    i3 = half * (((2 - FLAT) / (1 + (1 - FLAT) * root)) @ _WEIGHT)
    return w2 - w1 - FLAT * sa0 * i3, i1


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres on WGS84, always convergent.

    Points are put in Karney's canonical order (first latitude negative and larger in size), where the
    longitude difference grows with the first azimuth; the azimuth is found by bracketing (Illinois),
    the integrals by Gauss-Legendre quadrature of the exact integrands.
    """
    p1, p2 = np.asarray(lat1, float), np.asarray(lat2, float)
    lam = np.abs(np.radians(((np.asarray(lon2, float) - np.asarray(lon1, float)) + 180) % 360 - 180))
    swap = np.abs(p1) < np.abs(p2)
    p1, p2 = np.where(swap, p2, p1), np.where(swap, p1, p2)
    sign = np.where(p1 > 0, -1.0, 1.0)
    be1 = np.minimum(np.arctan((1 - FLAT) * np.tan(np.radians(p1 * sign))), -1e-30)
    be2 = np.clip(np.arctan((1 - FLAT) * np.tan(np.radians(p2 * sign))), be1, -be1)
    ep2 = (A**2 - B**2) / B**2
    lo, hi = np.zeros_like(lam), np.full_like(lam, np.pi)
    flo, fhi = -lam, np.pi - lam
    side = np.zeros(lam.shape, int)
    best, miss = lo.copy(), np.full_like(lam, np.inf)
    for k in range(80):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (lo * fhi - hi * flo) / (fhi - flo)
        x = np.where(np.isfinite(x) & (x >= lo) & (x <= hi) & (k % 4 < 3), x, (lo + hi) / 2)
        f = _arc(x, be1, be2, ep2)[0] - lam
        near = np.abs(f) < miss
        best, miss = np.where(near, x, best), np.where(near, np.abs(f), miss)
        left = f < 0
        # A bound kept twice counts half.
        fhi = np.where(left, np.where(side == -1, fhi / 2, fhi), f)
        flo = np.where(left, f, np.where(side == 1, flo / 2, flo))
        lo, hi = np.where(left, x, lo), np.where(left, hi, x)
        side = np.where(left, -1, 1)
        if (miss < 1e-15).all() or ((hi - lo) < 1e-15).all():
            break
    x = np.where(lam == 0, 0.0, best)
    out = B * _arc(x, be1, be2, ep2)[1]
    # Along the equator, short of the point where shorter ways over the poles begin.
    flat = (p1 == 0) & (p2 == 0) & (lam <= (1 - FLAT) * np.pi)
    return np.where(flat, A * lam, out)


def geodesic_lengths(geoms: list, method: str = "geodesic") -> np.ndarray:
    """Lengths of many geometries; the segments of all go through one vectorised call."""
    ends, owner = [], []
    for i, g in enumerate(geoms):
        for r in _chains(g):
            if len(r) > 1:
                r = _xy(r)
                ends.append(np.hstack([r[:-1], r[1:]]))
                owner.append(np.full(len(r) - 1, i))
    if not ends:
        return np.zeros(len(geoms))
    return np.bincount(np.concatenate(owner), METHODS[method](*np.concatenate(ends).T), len(geoms))


def geodesic_length(geom, method: str = "geodesic") -> float:
    return float(geodesic_lengths([geom], method)[0])


def _haversine(lon1, lat1, lon2, lat2):
    from .native import EARTH_RADIUS

    p1, p2 = np.radians(lat1), np.radians(lat2)
    u, v = np.sin((p2 - p1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS * np.arcsin(np.minimum(1, np.sqrt(u * u + np.cos(p1) * np.cos(p2) * v * v)))


METHODS = {"geodesic": geodesic, "vincenty": vincenty, "haversine": _haversine}


def method_name(method: str) -> str:
    if method.lower() not in METHODS:
        raise InvalidOperationError(f"unknown method {method!r}. Use one of geodesic, haversine or vincenty")
    return method.lower()


# ---- maps --------------------------------------------------------------------------------------
def origin_of(geom, origin):
    if origin == "center":
        b = bounds(geom)
        return b and ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    if origin == "centroid":
        c = centroid(geom)
        return c and c[1]
    return origin


def affine(geom, matrix, origin=None):
    a, b, d, e, xo, yo = matrix
    if origin is not None:
        o = origin_of(geom, origin)
        if o is None:
            return geom
        xo, yo = o[0] - a * o[0] - b * o[1], o[1] - d * o[0] - e * o[1]
    return map_positions(geom, lambda p: (a * p[0] + b * p[1] + xo, d * p[0] + e * p[1] + yo, *p[2:]))


# ---- Arrow-batched functions -------------------------------------------------------------------
def column(f, returns: str, g: Column, kind: str, *more: tuple[Column, str]) -> Column:
    """f(plain geometry, ...) over columns; null in, null out; geometries out are WKB (returns 'wkb')."""
    kinds = (kind, *[k for _, k in more])
    out_type = "binary" if returns == "wkb" else returns

    def one(*values):
        if any(v is None for v in values):
            return None
        got = f(*[codec.from_storage(k, v) for k, v in zip(kinds, values, strict=True)])
        return codec.to_wkb(got) if returns == "wkb" and got is not None else got

    # A struct column would reach the function as a frame; as a one-element array it comes as values.
    wrapped = [F.array(c) if k == "point" else c for c, k in ((g, kind), *more)]

    def plain(v, k):
        if v is None:
            return None
        if k == "point":
            return v[0]
        return _lists(v) if k not in ("wkb", "wkt") else v

    @F.pandas_udf(out_type)
    def run(batches: pd.Series, *rest: pd.Series) -> pd.Series:
        series = (batches, *rest)
        return pd.Series([one(*[plain(v, k) for v, k in zip(row, kinds, strict=True)]) for row in zip(*series, strict=True)], dtype=object)

    return run(*wrapped)


def geodesic_column(g: Column, kind: str, method: str) -> Column:
    """Geodesic lengths, a batch at a time."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        out = np.full(len(s), np.nan, object)
        out[:] = None
        at = [i for i, v in enumerate(s) if v is not None]
        got = geodesic_lengths([codec.from_storage(kind, (v[0] if kind == "point" else _lists(v) if kind not in ("wkb", "wkt") else v)) for v in (s.iloc[i] for i in at)], method)
        for i, x in zip(at, got, strict=True):
            out[i] = float(x)
        return pd.Series(out, dtype=object)

    return run(F.array(g) if kind == "point" else g)


def _lists(v):
    return [_lists(x) for x in v] if isinstance(v, (list, np.ndarray)) else v


def title(geom) -> str:
    return TITLES[geom[0]]


def only_point(geom, axis: int) -> float:
    if geom[0] != "point":
        raise ComputeError(f"x and y are defined for points, not for {title(geom)}")
    return float(geom[1][axis]) if geom[1] is not None else math.nan
