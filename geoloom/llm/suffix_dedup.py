"""Substring deduplication over a suffix array sorted deep-shallow.

A byte goes if a `span`-byte string that covers it also starts in a document with a smaller doc_id.

1. Equal texts are brought together by hash; the smallest doc_id stands for them.
2. Anchors. In every `span`-byte string the 16-byte gram of smallest hash is its anchor, so equal
   strings have equal anchors. Strings next to each other with one anchor form a piece (50 to 84
   bytes). A block of documents sends each of its anchors once to the anchor's bucket; anchors of
   two documents or more are sent back.
3. Suffix sorting. Blocks send the pieces at such anchors, equal pieces once with the block's
   smallest doc_id, to the anchor's bucket, which sorts all suffixes of at least `span` bytes of the
   distinct pieces: multikey quicksort on 8-byte symbols to the shallow depth of 24 bytes, then a
   blind trie orders each group, of two or more, that is still equal. Neighbours with a common prefix of `span` bytes
   are one string; its smallest doc_id goes back to the blocks.
4. Blocks mark the covered bytes.

A passage that a third of all documents share is one piece a block. Pieces are named by 128-bit hashes.

Defined cases: a null text is empty; texts under `span` bytes lose nothing; a null doc_id counts as
larger than all others; repeated rows of a doc_id do not remove each other; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc
from .lm_score import decode, encode, merged

_U = np.uint64
GRAM = 16
SHALLOW = 24
BATCH = 1 << 17
LAST = np.iinfo(np.int64).max
_BYTES = tc.seeded(31, 256)
_MULS = tc.seeded(32, 8) | _U(1)
_SECOND = tc.seeded(33, 256)


# ---- anchors and pieces ------------------------------------------------------------------------
def pieces(data: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first start, last start, 48-bit anchor name, document."""
    none = np.zeros(0, np.int64)
    idx, ptr = tc.gram_ptr(off, span)
    if not len(idx):
        return none, none, np.zeros(0, np.uint64), none
    with np.errstate(over="ignore"):
        h = _BYTES[data]
        size = 1
        for m in _MULS[:4]:  # grams of 2, 4, 8 and 16 bytes
            h = h[:-size] * m + h[size:]
            size *= 2
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, span - GRAM + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    at = (low[idx] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(idx), bool)
    new[1:] = (at[1:] != at[:-1]) | (idx[1:] != idx[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(idx)) - 1
    doc = np.searchsorted(ptr, first, side="right") - 1
    return idx[first], idx[last], tc.mix(h[at[first]]) >> _U(16), doc


# ---- suffix sorting ----------------------------------------------------------------------------
def _symbols(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one big-endian number, so numbers compare as bytes do."""
    everywhere = np.ndarray(max(len(text) - 7, 0), ">u8", text, strides=(1,))
    return everywhere[at].astype(np.uint64)


class BlindTrie:
    """Orders byte strings of one length; inner nodes hold only a branching depth and first bytes.

    An insertion walks down blindly, comparing single bytes at branching depths, then compares once
    with the leaf it reached to find the true depth of difference. Equal strings share a leaf.
    """

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = [s, [item]]
            return
        node, walked = self.root, []
        while isinstance(node[1], dict):
            walked.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(item)
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        above = None
        node = self.root
        while isinstance(node[1], dict) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = [s, [item]]
        if isinstance(node[1], dict) and node[0] == depth:
            node[1][s[depth]] = leaf
            return
        inner = [depth, {other[depth]: node, s[depth]: leaf}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def ordered(self) -> list[list[int]]:
        """Items of equal strings, in the order of the strings."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (size[i] of them), one range after the other."""
    if len(start) == 1:
        return np.arange(start[0], start[0] + size[0])
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def multikey_quicksort(text: np.ndarray, at: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the places `at` by their first `limit` bytes, starts and sizes of the runs of two or more that agree on them).

    Symbols are 8 bytes. A segment is parted by the median of three of its symbols into smaller,
    equal and larger; the equal part goes on with the next symbol. Segments of a batch are parted
    together; a batch holds BATCH places, or one segment, so temporaries shrink with the segments.
    """
    text = np.ascontiguousarray(text)
    order, symbol = np.arange(len(at)), _symbols(text, at)  # both by place
    done: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [tuple(np.array([x]) for x in (0, len(at), 0))] if len(at) > 1 else []
    while todo:
        start, size, depth = todo.pop()
        edge = np.cumsum(size) - size
        place = _ranges(start, size)
        item, key = order[place], symbol[place]
        x, y, z = key[edge], key[edge + size // 2], key[edge + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        less, more = key < pivot, key > pivot
        parts = [np.flatnonzero(p) for p in (less, ~(less | more), more)]
        n_less, n_equal, n_more = (np.diff(np.append(np.searchsorted(p, edge), len(p))) for p in parts)
        first_equal = start + n_less
        first_more = first_equal + n_equal
        to = np.concatenate([_ranges(f, n) for f, n in ((start, n_less), (first_equal, n_equal), (first_more, n_more))])
        of = np.concatenate(parts)
        order[to], symbol[to] = item[of], key[of]
        # The equal parts move to the next symbol, or are done at the limit.
        many, end = n_equal > 1, depth + 8 >= limit
        done.append((first_equal[many & end], n_equal[many & end]))
        on = many & ~end
        place = _ranges(first_equal[on], n_equal[on])
        symbol[place] = _symbols(text, at[order[place]] + np.repeat(depth[on] + 8, n_equal[on]))
        start = np.concatenate([start, first_equal[on], first_more])
        size = np.concatenate([n_less, n_equal[on], n_more])
        depth = np.concatenate([depth, depth[on] + 8, depth])
        live = size > 1
        start, size, depth = start[live], size[live], depth[live]
        if len(start):
            cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // BATCH)) + 1
            todo += zip(*(np.split(x, cut) for x in (start, size, depth)), strict=True)
    start, size = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
    by = np.argsort(start)
    return order, start[by], size[by]


def sort_suffixes(text: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the places `at` by their span bytes, True where a string differs from the one before)."""
    depth = min(SHALLOW, span) // 8 * 8
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    new = np.ones(len(at), bool)
    order, start, size = multikey_quicksort(padded, at, depth) if depth else (np.arange(len(at)), np.zeros(1, np.int64), np.array([len(at)]))
    raw, rest = text.tobytes(), span - depth
    place = _ranges(start, size) if len(start) else np.zeros(0, np.int64)
    item = order[place]
    items, begins = item.tolist(), (at[item] + depth).tolist()
    sorted_, equal, a = [], [], 0
    for k in size.tolist():
        trie = BlindTrie()
        for i, p in zip(items[a : a + k], begins[a : a + k], strict=True):
            trie.insert(raw[p : p + rest], i)
        for same in trie.ordered():
            sorted_ += same
            if len(same) > 1:
                equal += range(len(sorted_) - len(same) + 1, len(sorted_))
        a += k
    order[place] = np.array(sorted_, np.int64)
    new[place[np.array(equal, np.int64)]] = False
    return order, new


def smallest_owner(text: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of at least span bytes of each piece: the smallest owner of an equal string; offsets by piece."""
    n = length - span + 1
    ptr = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ptr[1:])
    piece = np.repeat(np.arange(len(n)), n)
    at = start[piece] + np.arange(ptr[-1]) - ptr[:-1][piece]
    order, new = sort_suffixes(text, at, span)
    out = np.zeros(len(at), np.int64)
    if len(at):
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(owner[piece[order]], first)
        out[order] = np.repeat(low, np.diff(np.append(first, len(at))))
    return out, ptr


# ---- grouped passes ----------------------------------------------------------------------------
def _first_seen(batches):
    """Each text once a task; later smaller doc_ids of it follow without the text."""
    seen: dict[tuple[int, int], list] = {}
    schema = None
    for b in batches:
        # One schema for all batches: the input's columns are not nullable, a later row's text is null.
        schema = schema or pa.schema([pa.field(f.name, f.type) for f in b.schema])
        one, two, ids, block = (b.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "block"))
        fresh = []
        for i, (x, y, d, k) in enumerate(zip(one, two, ids, block, strict=True)):
            had = seen.get((x, y))
            if had is None:
                seen[(x, y)] = [d, d, k]
                fresh.append(i)
            elif d < had[1]:
                had[1] = d
        yield pa.RecordBatch.from_arrays(b.take(pa.array(fresh, pa.int64())).columns, schema=schema)
    rest = [(k, x, y, low, None) for (x, y), (d, low, k) in seen.items() if low < d]
    if rest:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest, strict=True), schema, strict=True)], schema=schema)


def _distinct(table):
    """(h1, h2, smallest doc_id, texts) of a block's distinct texts, ordered by hash."""
    one, two, ids = (table.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(new)
    has = ~table.column("text").combine_chunks().is_null().to_numpy(zero_copy_only=False)[order]
    place = np.where(has, np.arange(len(order)), len(order))
    text_row = np.minimum.reduceat(place, first) if len(first) else first
    return one[first], two[first], ids[first], table.column("text").combine_chunks().take(pa.array(order[text_row]))


def _bucket_rows(name: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the sorted 48-bit names of each bucket that has any."""
    if not len(name):
        return []
    bucket = ((name >> _U(16)) * _U(buckets)) >> _U(32)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(name)], strict=True))


def _named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of byte spans, in two halves."""
    return tc.span_hash(tc.prefix_hash(data), start, end), tc.span_hash(tc.prefix_hash(data, table=_SECOND), start, end)


def _piece_names(raw: np.ndarray, cut: np.ndarray, step: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Names of the pieces raw[cut[i]:cut[i + 1]], some thousands at a time."""
    parts = [(np.zeros(0, np.uint64),) * 2]
    for i in range(0, len(cut) - 1, step):
        c = cut[i : i + step + 1]
        parts.append(_named(raw[c[0] : c[-1]], c[:-1] - c[0], c[1:] - c[0]))
    one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
    return one, two


def _by_name(owner: np.ndarray, one: np.ndarray, two: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by `before`, name and owner, True where a name begins); the second half is sorted only where first halves collide."""
    for keys in ((owner, one, *before), (owner, two, one, *before)):
        order = np.lexsort(keys)
        x, y = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = x[1:] != x[:-1]
        other = np.append(False, y[1:] != y[:-1])[: len(order)]
        if not (other & ~new).any():
            break
    return order, new | other


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("blob", pa.binary())])


def _send_anchors(span: int, buckets: int):
    def run(key, table):
        _, _, _, texts = _distinct(table)
        names, counts = [], []
        for _, _, data, off in tc.chunks(texts):
            _, _, name, doc = pieces(data, off, span)
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            k, c = np.unique(name[new], return_counts=True)
            names.append(k)
            counts.append(c.astype(np.uint64))
        k, c = merged(names, counts)
        rows = [(i, key[0].as_py(), encode(k[a:b], np.minimum(c[a:b], _U(2)))) for i, a, b in _bucket_rows(k, buckets)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT) if rows else _SENT.empty_table()

    return run


def _shared_anchors(table):
    sent = [(b, *decode(x)) for b, x in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True)]
    k, c = merged([s[1] for s in sent], [s[2] for s in sent])
    k = k[c >= 2]
    rows = []
    for block, own, _ in sent:
        hit = own[_in(own, k)]
        if len(hit):
            rows.append((block, encode(hit, np.ones(len(hit), np.uint64))))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BACK, strict=True)], schema=_BACK) if rows else _BACK.empty_table()


def _in(a: np.ndarray, sorted_b: np.ndarray) -> np.ndarray:
    if not len(sorted_b):
        return np.zeros(len(a), bool)
    at = np.minimum(np.searchsorted(sorted_b, a), len(sorted_b) - 1)
    return sorted_b[at] == a


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    size = np.frombuffer(blob, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for s, kind in zip(size, kinds, strict=True):
        out.append(np.frombuffer(blob[at : at + int(s)], kind))
        at += int(s)
    return out


_PIECE = (np.int64, np.uint8, np.uint8, np.uint8)  # smallest doc_id, several?, length, bytes


def _send_pieces(span: int, buckets: int):
    def run(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        wanted = np.sort(np.concatenate([decode(x)[0] for x in answers.column("blob").to_pylist()]))
        _, _, ids, texts = _distinct(table)
        got = []
        for row, _, data, off in tc.chunks(texts):
            a, b, name, doc = pieces(data, off, span)
            hit = _in(name, wanted)
            a, b, name, doc = a[hit], b[hit], name[hit], doc[hit]
            if not len(a):
                continue
            end = b + span
            one, two = _named(data, a, end)
            length = end - a
            cut = np.cumsum(np.append(0, length))
            raw = data[np.arange(cut[-1]) + np.repeat(a - cut[:-1], length)]
            order, new = _by_name(ids[row + doc], one, two)
            first = np.flatnonzero(new)
            lead = order[first]
            many = np.diff(np.append(first, len(order))) > 1
            got.append((name[lead], one[lead], two[lead], ids[row + doc[lead]], many, length[lead], _slices(raw, cut, lead)))
        if not got:
            return _SENT.empty_table()
        name, one, two, owner, many, length, raw = (np.concatenate(x) for x in zip(*got, strict=True))
        cut = np.cumsum(np.append(0, length))
        order, new = _by_name(owner, one, two, name)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        many = np.logical_or.reduceat(many[order], first) | (size > 1)
        lead = order[first]
        rows = []
        for i, s, e in _bucket_rows(name[lead], buckets):
            part = lead[s:e]
            rows.append((i, key[0].as_py(), _pack(owner[part], many[s:e].astype(np.uint8), length[part].astype(np.uint8), _slices(raw, cut, part))))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return run


def _slices(raw: np.ndarray, cut: np.ndarray, which: np.ndarray) -> np.ndarray:
    """raw[cut[i]:cut[i + 1]] of the given i, one after the other."""
    size = cut[which + 1] - cut[which]
    to = np.cumsum(np.append(0, size))
    return raw[np.arange(to[-1]) + np.repeat(cut[which] - to[:-1], size)]


def _sort_bucket(span: int):
    def run(table):
        sent = [(b, *_unpack(x, *_PIECE)) for b, x in zip(table.column("block").to_pylist(), table.column("blob").to_pylist(), strict=True)]
        owner, length, raw = (np.concatenate([s[i] for s in sent]) for i in (1, 3, 4))
        cut = np.cumsum(np.append(0, length.astype(np.int64)))
        one, two = _piece_names(raw, cut)
        order, new = _by_name(owner, one, two)
        lead = order[np.flatnonzero(new)]  # distinct pieces, by name; the smallest owner leads
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        text = _slices(raw, cut, lead)
        size = length[lead].astype(np.int64)
        low, ptr = smallest_owner(text, np.cumsum(np.append(0, size))[:-1], size, owner[lead], span)
        # Runs of equal owners within a piece.
        edge = np.ones(len(low), bool)
        edge[1:] = low[1:] != low[:-1]
        edge[ptr[:-1]] = True
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], len(low))
        of = np.searchsorted(ptr, start, side="right") - 1
        a, b, m = (start - ptr[of]).astype(np.uint8), (stop - 1 - ptr[of]).astype(np.uint8), low[start]
        by = np.searchsorted(of, np.arange(len(lead) + 1))
        least = np.minimum.reduceat(low, ptr[:-1]) if len(low) else low
        one, two = one[lead], two[lead]
        rows, at = [], 0
        for block, mine, many, _, _ in sent:
            i = which[at : at + len(mine)]
            at += len(mine)
            i = i[(many > 0) | (least[i] < mine)]
            if len(i):
                n = by[i + 1] - by[i]
                pick = np.repeat(by[i] - np.cumsum(np.append(0, n))[:-1], n) + np.arange(n.sum())
                rows.append((block, _pack(np.repeat(one[i], n), np.repeat(two[i], n), a[pick], b[pick], m[pick])))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BACK, strict=True)], schema=_BACK) if rows else _BACK.empty_table()

    return run


_RESULT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def covered(data: np.ndarray, off: np.ndarray, ids: np.ndarray, span: int, one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk go, from the answers by piece (sorted by the first half of its name)."""
    gone = np.zeros(len(data), bool)
    first, last, _, doc = pieces(data, off, span)
    if not len(first) or not len(one):
        return gone
    own, half = _named(data, first, last + span)
    lo, hi = np.searchsorted(one, own), np.searchsorted(one, own, side="right")
    n = hi - lo
    pick = np.repeat(lo - np.cumsum(np.append(0, n))[:-1], n) + np.arange(n.sum())
    of = np.repeat(np.arange(len(first)), n)
    smaller = (two[pick] == half[of]) & (low[pick] < ids[doc[of]])
    pick, of = pick[smaller], of[smaller]
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, first[of] + a[pick], 1)
    np.add.at(change, first[of] + b[pick] + span, -1)
    return np.cumsum(change)[:-1] > 0


def _mark(span: int):
    def run(key, table, answers):
        if not table.num_rows:
            return _RESULT.empty_table()
        parts = [_unpack(x, np.uint64, np.uint64, np.uint8, np.uint8, np.int64) for x in answers.column("blob").to_pylist()]
        name, half, a, b, low = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64),) * 5
        order = np.argsort(name, kind="stable")
        name, half, a, b, low = name[order], half[order], a[order].astype(np.int64), b[order].astype(np.int64), low[order].astype(np.int64)
        one, two, ids, texts = _distinct(table)
        removed, spans, sha = [], [], []
        for row, _, data, off in tc.chunks(texts):
            gone = covered(data, off, ids[row:], span, name, half, a, b, low)
            for i in range(len(off) - 1):
                g, d = gone[off[i] : off[i + 1]], data[off[i] : off[i + 1]]
                k = int(g.sum())
                removed.append(k)
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
                sha.append(hashlib.sha256((d[~g] if k else d).tobytes()).hexdigest())
        return pa.table([pa.array(one), pa.array(two), pa.array(ids), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], schema=_RESULT)

    return run


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def dedup(docs: DataFrame, span: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; span from 16 to 135 bytes."""
    if not GRAM <= span <= 135:
        raise ValueError(f"span must be from {GRAM} to 135 bytes, not {span}")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text.alias("text"), F.col("doc_id").cast("long").alias("own_id")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(50), "text"), "n_bytes": F.octet_length("text").cast("long")})
    blocks = common.blocks_for(common.text_bytes(docs))
    dealt = rows.select(F.pmod("h1", F.lit(blocks)).cast("int").alias("block"), "h1", "h2", "doc_id", "text").mapInArrow(_first_seen, "block int, h1 long, h2 long, doc_id long, text string")
    sent, back = "bucket int, block int, blob binary", "block int, blob binary"
    anchors = dealt.groupBy("block").applyInArrow(_send_anchors(span, 2 * blocks), sent).groupBy("bucket").applyInArrow(_shared_anchors, back)
    sorted_ = dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_send_pieces(span, 2 * blocks), sent).groupBy("bucket").applyInArrow(_sort_bucket(span), back)
    result = dealt.groupBy("block").cogroup(sorted_.groupBy("block")).applyInArrow(_mark(span), "h1 long, h2 long, first_id long, n_removed long, n_spans long, kept_sha256 string")
    light = rows.select("own_id", "doc_id", "h1", "h2", "n_bytes").join(result, ["h1", "h2"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= span)
    return light.select(F.col("own_id").alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
