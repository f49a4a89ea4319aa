"""Operators on WKB columns, a whole Arrow batch at a time.

A batch of WKB is decoded in lock-step: every geometry has a cursor, and one numpy step reads the next
header, count or ring of all that have one. What comes out is ragged: chains (points, lines, rings) with
their owner, and one array of positions. Measures are sums over chains and owners. Hulls, exterior rings
and distances of other than points stay with the single-geometry kernels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import codec
from ..errors import ComputeError
from ..types import TITLES
from . import kernels

POINT, LINE, POLYGON = (codec.CODES[k] for k in ("point", "linestring", "polygon"))


class _Reader:
    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends, self.chains = data, ends, []

    def room(self, at, owner, n) -> None:
        if (at + n > self.ends[owner]).any():
            raise ComputeError("WKB ends early")

    def number(self, at, owner, big) -> np.ndarray:
        self.room(at, owner, 4)
        b = self.data[at[:, None] + np.arange(4)].astype(np.int64)
        return np.where(big, b @ (1 << np.arange(24, -1, -8)), b @ (1 << np.arange(0, 32, 8)))

    def head(self, at, owner):
        if (at >= self.ends[owner]).any() or (self.data[at] > 1).any():
            raise ComputeError("WKB has no byte order mark")
        big = self.data[at] == 0
        code = self.number(at + 1, owner, big)
        srid = (code & 0x20000000) != 0
        z, m = (code & 0x80000000) != 0, (code & 0x40000000) != 0
        iso, base = np.divmod(code & 0x0FFFFFFF, 1000)
        if ((base < POINT) | (base > max(codec.KIND_OF)) | (iso > 3)).any():
            raise ComputeError("unsupported WKB geometry code")
        at = at + 5 + 4 * srid
        self.room(at, owner, 0)
        dims = 2 + (z | (iso == 1) | (iso == 3)) + (m | (iso == 2) | (iso == 3))
        return at, big, base, dims, big | srid | z | m

    def geometries(self, at, owner) -> np.ndarray:
        """Cursors after the geometries that begin at these."""
        at, big, base, dims, _ = self.head(at, owner)
        for kind in np.unique(base):
            pick = np.flatnonzero(base == kind)
            at[pick] = self.body(kind, at[pick], owner[pick], big[pick], dims[pick])
        return at

    def body(self, kind, at, owner, big, dims) -> np.ndarray:
        if kind == POINT:
            return self.chain(kind, at, owner, big, dims, np.ones(len(at), np.int64), at)
        parts = self.number(at, owner, big)
        at = at + 4
        if kind == LINE:
            return self.chain(kind, at, owner, big, dims, parts, at)
        whole, done = at.copy(), 0
        live = np.flatnonzero(parts > 0)
        while len(live):
            if kind == POLYGON:
                n = self.number(at[live], owner[live], big[live])
                at[live] = self.chain(kind, at[live] + 4, owner[live], big[live], dims[live], n, whole[live])
            else:
                at[live] = self.geometries(at[live], owner[live])
            done += 1
            live = live[parts[live] > done]
        return at

    def chain(self, kind, at, owner, big, dims, n, whole) -> np.ndarray:
        self.room(at, owner, n * dims * 8)
        self.chains.append((at, n, dims, big, owner, np.full(len(at), kind), whole))
        return at + n * dims * 8


def _segmented(f, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """f over each owner's run of values (owners ascend); NaN for owners without values."""
    out = np.full(n, np.nan)
    if len(values):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = f.reduceat(values, first)
    return out


@dataclass
class Batch:
    """n geometries: code by geometry; owner, kind and shell (of rings) by chain; xy with chain and byte place by position."""

    n: int
    code: np.ndarray
    dims: np.ndarray
    plain: np.ndarray  # little-endian ISO heads
    data: np.ndarray
    off: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    shell: np.ndarray
    first: np.ndarray
    last: np.ndarray
    xy: np.ndarray
    chain: np.ndarray
    place: np.ndarray

    def segments(self) -> np.ndarray:
        """Positions that begin a segment of a line or ring."""
        if not len(self.chain):
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.chain[1:] == self.chain[:-1]) & (self.kind[self.chain[:-1]] != POINT))

    def per_owner(self, values: np.ndarray, chain: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[chain], values, self.n)

    def _rings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chains that are rings, twice their signed area, moments about their first position)."""
        at = self.segments()
        at = at[self.kind[self.chain[at]] == POLYGON]
        own = self.chain[at]
        base = self.xy[self.first[own]]
        d, e = self.xy[at] - base, self.xy[at + 1] - base
        cross = d[:, 0] * e[:, 1] - e[:, 0] * d[:, 1]
        k = len(self.owner)
        moment = np.stack([np.bincount(own, (d[:, i] + e[:, i]) * cross, k) for i in (0, 1)], axis=1)
        rings = np.flatnonzero(self.kind == POLYGON)
        return rings, np.bincount(own, cross, k)[rings], moment[rings]

    def _sign(self, rings: np.ndarray) -> np.ndarray:
        return np.where(self.shell[rings], 1.0, -1.0)

    def area(self) -> np.ndarray:
        rings, twice, _ = self._rings()
        return self.per_owner(np.abs(twice) / 2 * self._sign(rings), rings)

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.segments()
        return at, np.hypot(*(self.xy[at + 1] - self.xy[at]).T)

    def length(self) -> np.ndarray:
        at, step = self._steps()
        return self.per_owner(step, self.chain[at])

    def geodesic_length(self, method: str) -> np.ndarray:
        at = self.segments()
        if not len(at):
            return np.zeros(self.n)
        return self.per_owner(kernels.METHODS[method](*self.xy[at].T, *self.xy[at + 1].T), self.chain[at])

    def centroid(self) -> np.ndarray:
        """By area; without area by length; without length the mean; NaN if empty."""
        rings, twice, moment = self._rings()
        flat = twice == 0
        weight = np.abs(twice) * self._sign(rings)
        centre = self.xy[self.first[rings]] + moment / np.where(flat, 1, 3 * twice)[:, None]
        at, step = self._steps()
        ways = [
            (weight, centre, rings),
            (step, (self.xy[at] + self.xy[at + 1]) / 2, self.chain[at]),
            (np.ones(len(self.xy)), self.xy, self.chain),
        ]
        out, left = np.full((self.n, 2), np.nan), np.ones(self.n, bool)
        for w, where, own in ways:
            total = self.per_owner(w, own)
            pick = left & (total != 0)
            for i in (0, 1):
                out[pick, i] = self.per_owner(w * where[:, i], own)[pick] / total[pick]
            left &= ~pick
        return out

    def bounds(self) -> np.ndarray:
        """(xmin, ymin, xmax, ymax); NaN if empty."""
        own = self.owner[self.chain]
        return np.stack([_segmented(f, self.xy[:, i], own, self.n) for f in (np.minimum, np.maximum) for i in (0, 1)], axis=1)

    def is_empty(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n) == 0

    def is_ring(self) -> np.ndarray:
        out = np.zeros(self.n, bool)
        line = np.flatnonzero(self.code[self.owner] == LINE)
        out[self.owner[line]] = (self.xy[self.first[line]] == self.xy[self.last[line]]).all(axis=1)
        return out

    def points(self) -> np.ndarray:
        """Positions of a batch of points only; NaN if empty."""
        bad = np.flatnonzero(self.code != POINT)
        if len(bad):
            raise ComputeError(f"x and y are defined for points, not for {TITLES[codec.KIND_OF[int(self.code[bad[0]])]]}")
        out = np.full((self.n, 2), np.nan)
        out[self.owner] = self.xy[self.first]
        return out

    def blob(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def geometry(self, i: int):
        return codec.from_wkb(self.blob(i))


def decode(blobs: pa.Array) -> Batch:
    """A binary array without nulls; ComputeError if a geometry is malformed or has bytes left over."""
    blobs = blobs.cast(pa.large_binary())
    n = len(blobs)
    off = np.frombuffer(blobs.buffers()[1], np.int64, n + 1, blobs.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(blobs.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    data = np.append(raw[off[0] : off[-1]], np.zeros(16, np.uint8))  # so that views at any alignment reach the end
    off = off - off[0]
    reader = _Reader(data, off[1:])
    start, everyone = off[:-1].copy(), np.arange(n)
    _, _, code, dims, odd = reader.head(start, everyone)
    left = off[1:] - reader.geometries(start, everyone)
    if left.any():
        raise ComputeError(f"{int(left[left != 0][0])} bytes after the WKB geometry")
    at, count, width, big, owner, kind, whole = (np.concatenate(c) for c in zip(*reader.chains, strict=True)) if reader.chains else (np.zeros(0, np.int64) for _ in range(7))
    order = np.argsort(at, kind="stable")
    order = order[count[order] > 0]
    at, count, width, big, owner, kind, whole = (c[order] for c in (at, count, width, big.astype(bool), owner, kind, whole))
    # Positions: chains begin at any byte, so each alignment has a view of its own.
    chain = np.repeat(np.arange(len(at)), count)
    begin = np.cumsum(count) - count
    place = at[chain] + (np.arange(len(chain)) - begin[chain]) * width[chain] * 8
    xy = np.empty((len(chain), 2))
    for k in range(8):
        pick = np.flatnonzero(place % 8 == k)
        view = data[k : k + (len(data) - k) // 8 * 8].view(np.float64)
        xy[pick, 0], xy[pick, 1] = view[place[pick] // 8], view[place[pick] // 8 + 1]
    turned = big[chain]
    xy[turned] = xy[turned].byteswap()
    # A point without coordinates is no position.
    none = (kind[chain] == POINT) & np.isnan(xy).all(axis=1)
    if none.any():
        stay = np.ones(len(at), bool)
        stay[chain[none]] = False
        chain, xy, place = (np.cumsum(stay) - 1)[chain[~none]], xy[~none], place[~none]
        owner, kind, whole, count = owner[stay], kind[stay], whole[stay], count[stay]
        begin = np.cumsum(count) - count
    shell = np.ones(len(whole), bool)
    shell[1:] = whole[1:] != whole[:-1]
    nested = np.bincount(owner, minlength=n) != 1  # members may have heads of their own
    plain = ~odd & ~(nested & (code > POLYGON))
    return Batch(n, code, dims, plain, data, off, owner, kind, shell, begin, begin + count - 1, xy, chain, place)


# ---- results -----------------------------------------------------------------------------------
def _points(xy: np.ndarray) -> list:
    """WKB points; null where there is none."""
    out = np.zeros((len(xy), 21), np.uint8)
    out[:, 0], out[:, 1] = 1, POINT
    out[:, 5:] = np.ascontiguousarray(xy).view(np.uint8).reshape(len(xy), 16)
    none = np.isnan(xy).all(axis=1)
    return [None if no else r.tobytes() for r, no in zip(out, none, strict=True)]


def _centroid(b: Batch) -> list:
    return _points(b.centroid())


def _envelope(b: Batch) -> list:
    box = b.bounds()
    out = np.zeros((b.n, 93), np.uint8)
    out[:, [0, 5, 9]] = 1, 1, 5
    out[:, 1] = POLYGON
    ring = np.ascontiguousarray(box[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]])
    out[:, 13:] = ring.view(np.uint8).reshape(b.n, 80)
    none = b.is_empty()
    return [None if none[i] else codec.to_wkb(b.geometry(i)) if b.code[i] == POINT else out[i].tobytes() for i in range(b.n)]


def _single(f):
    """A single-geometry kernel that gives a geometry."""

    def run(b: Batch) -> list:
        got = [f(b.geometry(i)) for i in range(b.n)]
        return [None if g is None else codec.to_wkb(g) for g in got]

    return run


_TITLE = {code: TITLES[kind] for kind, code in codec.CODES.items()}

#: Each operator's Spark type and its function of a batch.
OPERATORS = {
    "area": ("double", Batch.area),
    "length": ("double", Batch.length),
    "geodesic_length": ("double", lambda b: b.geodesic_length("geodesic")),
    "centroid": ("binary", _centroid),
    "convex_hull": ("binary", _single(kernels.convex_hull)),
    "envelope": ("binary", _envelope),
    "exterior": ("binary", _single(kernels.exterior)),
    "geom_type": ("string", lambda b: [_TITLE[c] for c in b.code.tolist()]),
    "is_empty": ("boolean", Batch.is_empty),
    "is_ring": ("boolean", Batch.is_ring),
    "x": ("double", lambda b: b.points()[:, 0]),
    "y": ("double", lambda b: b.points()[:, 1]),
}
_ARROW = {"double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _spread(values, there: np.ndarray, returns: str) -> pa.Array:
    """Values at the places that are there, null elsewhere."""
    got = pa.array(values, _ARROW[returns])
    at = np.cumsum(there) - 1
    return got.take(pa.array(at, mask=~there)) if len(got) else pa.nulls(len(there), _ARROW[returns])


def _there(*columns: pa.Array) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    for c in columns:
        out &= c.is_valid().to_numpy(zero_copy_only=False)
    return out


def function(f, returns: str):
    """The Arrow function of f(batch) over a WKB column; null in, null out."""

    @F.arrow_udf(returns)
    def run(g: pa.Array) -> pa.Array:
        there = _there(g)
        return _spread(f(decode(g.filter(pa.array(there)))), there, returns)

    return run


def column(name: str, g: Column) -> Column:
    """An operator of OPERATORS over a WKB column."""
    returns, f = OPERATORS[name]
    return function(f, returns)(g)


def geodesic(g: Column, method: str) -> Column:
    return function(lambda b: b.geodesic_length(method), "double")(g)


def affine(g: Column, matrix, origin=None) -> Column:
    """The map written over the coordinates of plain geometries; others go through the single-geometry kernel."""
    a, b, d, e, xo, yo = matrix

    def run(batch: Batch) -> list:
        if origin is None:
            shift = np.broadcast_to(np.array([xo, yo], float), (batch.n, 2))
        else:
            if isinstance(origin, str):
                box = batch.bounds() if origin == "center" else None
                o = batch.centroid() if box is None else (box[:, :2] + box[:, 2:]) / 2
            else:
                o = np.broadcast_to(np.array(origin, float), (batch.n, 2))
            shift = o - np.stack([a * o[:, 0] + b * o[:, 1], d * o[:, 0] + e * o[:, 1]], axis=1)
        own, x, y = batch.owner[batch.chain], batch.xy[:, 0], batch.xy[:, 1]
        moved = np.stack([a * x + b * y + shift[own, 0], d * x + e * y + shift[own, 1]], axis=1)
        data = batch.data.copy()
        for k in range(8):
            pick = np.flatnonzero((batch.place % 8 == k) & batch.plain[own])
            view = data[k : k + (len(data) - k) // 8 * 8].view(np.float64)
            view[batch.place[pick] // 8], view[batch.place[pick] // 8 + 1] = moved[pick, 0], moved[pick, 1]
        return [data[batch.off[i] : batch.off[i + 1]].tobytes() if batch.plain[i] else codec.to_wkb(kernels.affine(batch.geometry(i), matrix, origin)) for i in range(batch.n)]

    return function(run, "binary")(g)


def distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Least planar distances row by row; points at once, others one by one."""
    there = _there(a, b)
    p, q = (decode(c.filter(pa.array(there))) for c in (a, b))
    some = ~p.is_empty() & ~q.is_empty()
    out = np.full(p.n, np.nan)
    both = (p.code == POINT) & (q.code == POINT) & some
    first, second = (np.full((c.n, 2), np.nan) for c in (p, q))
    for place, c in ((first, p), (second, q)):
        single = c.code[c.owner] == POINT
        place[c.owner[single]] = c.xy[c.first[single]]
    out[both] = np.hypot(*(second[both] - first[both]).T)
    for i in np.flatnonzero(some & ~both):
        out[i] = kernels.distance(p.geometry(i), q.geometry(i))
    return _spread(pa.array(out, mask=~some), there, "double")


def distance(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return distances(a, b)

    return run(a, b)


def meets_box(g: Column, box) -> Column:
    """Whether geometries meet the box (borders count); bounding boxes decide but for those that straddle its edge."""
    x0, y0, x1, y1 = box
    frame = ("polygon", [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]])

    def run(b: Batch) -> np.ndarray:
        lo, hi = np.split(b.bounds(), 2, axis=1)
        low, high = np.array([x0, y0]), np.array([x1, y1])
        near = ((lo <= high) & (hi >= low)).all(axis=1)  # false where empty
        out = near & ((lo >= low) & (hi <= high)).all(axis=1)
        for i in np.flatnonzero(near & ~out):
            out[i] = kernels.distance(b.geometry(i), frame) == 0
        return out

    return F.coalesce(function(run, "boolean")(g), F.lit(False))
