"""Vectorised text primitives on Arrow string buffers.

Texts stay as the UTF-8 bytes Arrow hands over; words, hashes and windows are numpy arrays over
those bytes, so no Python object is made per word. A chunk of rows is sized by bytes
(`CHUNK_BYTES`), never by truncating a text: one longer text is one chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; temporaries are about 60 bytes per text byte.
CHUNK_BYTES = 1 << 20

# ASCII white space that separates words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift multiply), a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _P)


_BYTE = seeded(1, 256)
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        base = np.full(size, _P if kind == "pow" else _PINV, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have[:n]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about `size` bytes."""
    size = size or CHUNK_BYTES
    data, off = buffers(col)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that stay within a document: starts, ends, and the runs' offsets by document."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | brk[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | brk[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, and offsets by document."""
    return runs(~IS_SPACE[data], off)


def prefix_hash(data: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
    """Polynomial prefix sums H with H[b] - H[a] the hash of data[a:b], shifted by P**a; `table` gives other values of the bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        values = table if table is not None else _BYTE_LOWER if lower else _BYTE
        np.cumsum(values[data] * _power("pow", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * _power("inv", len(prefix))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


_GRAM = seeded(2, 64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive elements of h (len(h) - k + 1 of them), sensitive to order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * (_GRAM[0] | _U(1))
        for j in range(1, k):
            out += h[j : j + n] * (_GRAM[j] | _U(1))
        return mix(out)


def gram_ptr(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which k-windows stay within a document: (indices of windows, offsets of them by document)."""
    count = np.maximum(np.diff(ptr) - (k - 1), 0)
    out = np.zeros(len(ptr), np.int64)
    np.cumsum(count, out=out[1:])
    idx = np.arange(out[-1]) + np.repeat(ptr[:-1] - out[:-1], count)
    return idx, out


def unhex(h: np.ndarray) -> np.ndarray:
    """uint64 as the signed longs that Spark holds."""
    return h.astype(np.uint64).view(np.int64)


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def crc_mod(column: str, modulus: int):
    """crc32 of a column written as text, by the modulus, as a Spark expression (null doc ids count as '')."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
