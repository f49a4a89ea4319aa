"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Tokens. Each task reads its documents once and cuts them into blocks of about BLOCK_BYTES; a block is
one row of a written table with its distinct word hashes in order and its texts as ranks of words, so texts
are never shuffled and repeated rows stay where they are.

Counting. A block sends each of its distinct words and word pairs once, with its count, to the bucket
of the (first) word's hash; a bucket adds up and answers each block in the order in which it has sent.
A word that a third of all documents use is one entry a block. The entries of a block go out as one
Arrow batch cut at the buckets' edges, without a step of Python for each bucket, and a block sends to
no more buckets than it has words.

Model. Every word and pair of the training text, those seen once included, enters the Bloom filter
of its bucket once for each level 1..q of its logarithmically quantised count (base sqrt 2, level 1
at one; Talbot and Osborne 2007). Its counts come back from repeated membership probes until a level is
absent. Buckets, and with them the filters, grow in number with the corpus, so nothing is left out at
any size; they are probed where they stand, and no filter is broadcast. The first level has so many
probes that among all words of the vocabulary as successors of one context about one in a hundred
contexts meets a false one.

With q the count by probes, V the words of the training text, Z(c) the sum of q over the successors
of c, and M that over words,

    P(w | c) = weight(Z(c)) * q(c, w) / Z(c) + (1 - weight(Z(c))) * (q(w) + 0.1) / (M + 0.1 * (V + 1))

so the probabilities of the V words and of one unknown word add up to 1 in each context. A text's first
token has no context (weight 0). The weights are set by leave-one-out expectation maximisation over all
training rows: a token's part in it depends only on the levels of word, context and pair, so the rounds
run on the counts of the different triples.

Words are compared by 64-bit hashes (two different words of 10 million collide with a chance of
3e-6), the second words of a context by 32 bits (of a million successors of one word some hundred count
as one). Defined cases: a null text is empty and has the end token alone; null doc ids are
scored; repeated rows count and are scored each; an empty table gives an empty result; without
training tokens all counts are 0. Extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

_U = np.uint64
END = _U(0xE0D0_5EED_0000_0001)
LEVELS = 100  # of counts, base sqrt 2
PROBES = 4  # of a level above the first
BITS = 10  # of the filter for each entry of a level above the first
BUCKET_TOKENS = 1_400_000
BINS = (10, 100, 1000, 10000)  # context counts that part the weights
_LEVEL = tc.seeded(11, LEVELS + 1)


# ---- compact numbers ---------------------------------------------------------------------------
def _planes(a: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed; headed by the planes' number and size."""
    w = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    raw = np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes()
    body = pa.compress(raw, codec="zstd", asbytes=True)
    return w.to_bytes(1, "little") + len(raw).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body


def _unplaned(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(the numbers that start at a place, the place after them)."""
    w, size, held = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little"), int.from_bytes(blob[at + 9 : at + 17], "little")
    raw = np.frombuffer(pa.decompress(blob[at + 17 : at + 17 + held], size, codec="zstd"), np.uint8)
    a = np.zeros((size // w, 8), np.uint8)
    a[:, :w] = raw.reshape(w, -1).T
    return a.view(np.uint64).ravel(), at + 17 + held


def encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as their gaps, then the counts."""
    return _planes(np.diff(keys, prepend=_U(0))) + _planes(counts)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, at = _unplaned(blob)
    return np.cumsum(gap, dtype=np.uint64), _unplaned(blob, at)[0]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], (np.add.reduceat(c, first) if len(first) else c)


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of an array as one binary value for each stretch between edges."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // len(values) if len(values) else 1
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int64)), pa.py_buffer(values)])


def _joined(col: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a binary column, how many each row has)."""
    col = col.cast(pa.large_binary()).combine_chunks()
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    kind = np.dtype(kind)
    return np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(kind) if raw is not None and off[-1] > off[0] else np.zeros(0, kind), np.diff(off) // kind.itemsize


# ---- tokens and blocks -------------------------------------------------------------------------
def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, words and then the end; offsets by document."""
    starts, ends, ptr = tc.words(data, off)
    h = tc.span_hash(tc.prefix_hash(data, lower=True), starts, ends)
    n = np.diff(ptr)
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(n + 1, out=out_ptr[1:])
    out = np.full(out_ptr[-1], END, np.uint64)
    out[np.arange(len(h)) + np.repeat(out_ptr[:-1] - ptr[:-1], n)] = h
    return out, out_ptr


def _ranked(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, the most frequent first, so that ranks compress well; the rank of each element)."""
    import pandas as pd

    code, seen = pd.factorize(t)
    order = np.argsort(-np.bincount(code, minlength=len(seen)), kind="stable")
    rank = np.zeros(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    return seen[order], rank[code]


_BLOCK = "block long, tokens long, ids array<long>, held array<boolean>, lens array<int>, words binary, codes binary"


def _tokenise(size: int):
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, held, lens, toks, waiting = [], [], [], [], 0

        def block():
            words, codes = _ranked(np.concatenate(toks))
            n = np.concatenate(lens).astype(np.int32)
            whole = lambda cols: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(cols))
            values = [pa.array([(part << 32) | made]), pa.array([len(codes)]), whole(ids), whole(held), whole([pa.array(n)]), pa.array([words.tobytes()], pa.binary()), pa.array([_planes(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in _BLOCK.split(", ")])

        for b in batches:
            for a, z, data, off in tc.chunks(b.column("text"), 4 * tc.CHUNK_BYTES):
                t, ptr = tokens(data, off)
                ids.append(b.column("doc_id")[a:z])
                held.append(b.column("held_out")[a:z])
                lens.append(np.diff(ptr))
                toks.append(t)
                waiting += len(data)
                if waiting >= size:
                    yield block()
                    made += 1
                    ids, held, lens, toks, waiting = [], [], [], [], 0
        if toks:
            yield block()

    return run


def _blocks(batches):
    """(block, held, tokens by document, word hashes in order, tokens as places in them, the place of each rank) of written rows."""
    for b in batches:
        for i in range(len(b)):
            row = b.slice(i, 1)
            held, lens = (row.column(c).flatten() for c in ("held", "lens"))
            words = np.frombuffer(row.column("words")[0].as_py(), np.uint64)
            order = np.argsort(words)
            place = np.zeros(len(words), np.int64)
            place[order] = np.arange(len(words))
            yield row.column("block")[0].as_py(), held.to_numpy(zero_copy_only=False), lens.to_numpy(), words[order], place[_unplaned(row.column("codes")[0].as_py())[0].astype(np.int64)], place


def _pairs(codes: np.ndarray, lens: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of tokens that follow another of their document, their pair as context rank * words + own rank)."""
    follows = np.ones(len(codes), bool)
    follows[np.cumsum(lens) - lens] = False
    at = np.flatnonzero(follows)
    return at, codes[at - 1] * words + codes[at]


# ---- counting ----------------------------------------------------------------------------------
_SENT = "bucket int, block long, word binary, times binary, pairs binary, next binary, paired binary, more binary"


def _send(buckets: int):
    def run(batches):
        for block, held, lens, words, codes, _ in _blocks(batches):
            learn = np.repeat(~held, lens)
            times = np.bincount(codes[learn], minlength=len(words)).astype(np.uint32)
            at, pair = _pairs(codes, lens, len(words))
            pair = np.sort(pair * 2 + learn[at])
            first = np.flatnonzero(np.append(True, pair[1:] >> 1 != pair[:-1] >> 1)) if len(pair) else np.zeros(0, np.int64)
            paired = np.add.reduceat(pair & 1, first) if len(first) else first
            ctx, after = np.divmod(pair[first] >> 1, len(words))
            low = (words[after] >> _U(32)).astype(np.uint32)
            more = np.flatnonzero(paired >= 255)
            edge = np.searchsorted(words, np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64))
            edge = np.concatenate([[0], edge, [len(words)]])
            to = np.flatnonzero(np.diff(edge))
            edge = np.append(edge[to], len(words))
            pair_edge = np.searchsorted(ctx, edge)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(np.full(len(to), block)), *(c.cast(pa.binary()) for c in (_cut(words, edge), _cut(times, edge), _cut(np.bincount(ctx, minlength=len(words)).astype(np.uint32), edge), _cut(low, pair_edge), _cut(np.minimum(paired, 255).astype(np.uint8), pair_edge), _cut(paired[more], np.searchsorted(more, pair_edge))))],
                [c.split()[0] for c in _SENT.split(", ")],
            )

    return run


_REDUCED = "block long, bucket int, tokens long, types long, mass long, counts binary, levels binary, sums binary, pair_levels binary"
TOTALS = -1  # block of a bucket's totals


def _levels(c: np.ndarray) -> np.ndarray:
    """Quantised level of counts: 0 for none, else 1 + floor(log_base(c))."""
    q = np.zeros(len(c), np.int64)
    hit = c > 0
    q[hit] = 1 + np.floor(2 * np.log2(c[hit].astype(np.float64)) + 1e-9).astype(np.int64)
    return np.minimum(q, LEVELS)


def _values() -> np.ndarray:
    """The count that each level stands for: the middle, by ratio, of its whole numbers."""
    out = [0]
    for q in range(1, LEVELS + 1):
        low, high = math.ceil(2 ** ((q - 1) / 2) - 1e-9), math.ceil(2 ** (q / 2) - 1e-9) - 1
        out.append(max(low, round((low * max(low, high)) ** 0.5)))
    return np.array(out, np.int64)


VALUE = _values()


def pair_key(ctx: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Filter key of a pair: hash of its context, 32 bits of that of its second word."""
    return tc.mix(ctx ^ tc.mix(after ^ _U(0x2222_0000_0000_0000)))


def _add_up(buckets: int):
    def run(key, table):
        row_block = table.column("block").to_numpy()
        sent, n_words = _joined(table.column("word"), np.uint64)
        times, ctx_pairs = (_joined(table.column(c), np.uint32)[0] for c in ("times", "pairs"))
        after, n_after = _joined(table.column("next"), np.uint32)
        paired = _joined(table.column("paired"), np.uint8)[0].astype(np.int64)
        paired[paired == 255] = _joined(table.column("more"), np.int64)[0]
        word, of = np.unique(sent, return_inverse=True)
        count = np.bincount(of, weights=times, minlength=len(word)).astype(np.int64)
        pair, pair_of = np.unique((np.repeat(of, ctx_pairs).astype(np.uint64) << _U(32)) | after, return_inverse=True)
        pair_count = np.bincount(pair_of, weights=paired, minlength=len(pair)).astype(np.int64)
        ctx = (pair >> _U(32)).astype(np.int64)
        keys = np.concatenate([tc.mix(word ^ _U(0x1111)), pair_key(word[ctx], pair & _U((1 << 32) - 1))])
        made = CountFilter(keys, np.concatenate([count, pair_count]), int((count > 0).sum()) * buckets)
        level = made.level(keys)
        level, pair_level = level[: len(word)], level[len(word) :]
        seen = pair_count > 0
        sums = np.bincount(ctx[seen], weights=VALUE[pair_level[seen]], minlength=len(word)).astype(np.int64)
        edge, pair_edge = (np.concatenate([[0], np.cumsum(n)]) for n in (n_words, n_after))
        n = len(row_block)
        zero = np.zeros(n, np.int64)
        answers = [row_block, np.full(n, key[0].as_py(), np.int32), zero, zero, zero, _cut(count[of], edge), _cut(level[of].astype(np.uint8), edge), _cut(sums[of], edge), _cut(pair_level[pair_of].astype(np.uint8), pair_edge)]
        totals = [[TOTALS], [key[0].as_py()], [int(count.sum())], [int((count > 0).sum())], [int(VALUE[level[count > 0]].sum())], *[[b""]] * 4]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        names = [c.split()[0] for c in _REDUCED.split(", ")]
        return pa.concat_tables([pa.table([a.cast(k) if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(part, kinds, strict=True)], names) for part in (answers, totals)])

    return run


# ---- filter ------------------------------------------------------------------------------------
class CountFilter:
    """Quantised counts by repeated membership probes, of the keys with a count and all others.

    vocabulary: how many words there are as possible successors; it sets the probes of the first level.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, vocabulary: int):
        level = _levels(count)
        self.first_probes = max(PROBES, math.ceil(math.log(100 * max(1, vocabulary)) / -math.log(1 - math.exp(-0.5))))
        self.first = self._filled([(key[level > 0], 1)], self.first_probes, 2 * self.first_probes * int((level > 0).sum()))
        self.top = int(level.max(initial=0))
        self.rest = self._filled([(key[level >= q], q) for q in range(2, self.top + 1)], PROBES, BITS * int(np.maximum(level - 1, 0).sum()))

    @staticmethod
    def _places(key: np.ndarray, level: int, probes: int, size: int):
        with np.errstate(over="ignore"):
            one = tc.mix(key ^ _LEVEL[level])
            step = tc.mix(one) | _U(1)
            for _ in range(probes):
                yield (((one >> _U(32)) * _U(size)) >> _U(32)).astype(np.int64)
                one = one + step

    def _filled(self, parts: list, probes: int, size: int) -> np.ndarray:
        bits = np.zeros(max(64, min(size, (1 << 32) - 8)), bool)
        for key, level in parts:
            for at in self._places(key, level, probes, len(bits)):
                bits[at] = True
        return bits

    def _has(self, key: np.ndarray, level: int) -> np.ndarray:
        bits, probes = (self.first, self.first_probes) if level == 1 else (self.rest, PROBES)
        out = np.ones(len(key), bool)
        for step in range(0, len(key), 1 << 18):  # in pieces that stay in the cache
            alive, some = np.arange(min(1 << 18, len(key) - step)), key[step : step + (1 << 18)]
            with np.errstate(over="ignore"):
                one = tc.mix(some ^ _LEVEL[level])
                more = tc.mix(one) | _U(1)
                for _ in range(probes):
                    hit = bits[(((one >> _U(32)) * _U(len(bits))) >> _U(32)).astype(np.int64)]
                    if not hit.all():
                        alive, one, more = alive[hit], one[hit], more[hit]
                    one = one + more
            own = np.zeros(len(some), bool)
            own[alive] = True
            out[step : step + len(some)] = own
        return out

    def level(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        alive = np.arange(len(key))
        for level in range(1, LEVELS + 1):
            alive = alive[self._has(key[alive], level)]
            if not len(alive):
                break
            out[alive] = level
        return out


# ---- scoring -----------------------------------------------------------------------------------
def _bins(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.digitize(context, BINS), 0)


def tune_weights(cells: np.ndarray, times: np.ndarray, mass: int, types: int, rounds: int = 8) -> np.ndarray:
    """Weight of the pair estimate by the bin of the context's count (bin 0, no context, has none).

    Cells are levels of word, context and pair of training tokens; each token is left out of its own counts.
    """
    weight = np.full(len(BINS) + 2, 0.3)
    weight[0] = 0
    word, ctx, pair = (np.maximum(VALUE[x] - 1, 0) for x in (cells >> 16, cells >> 8 & 255, cells & 255))
    uni = (word + 0.1) / (mass + 0.1 * (types + 1))
    two = np.where(ctx > 0, pair / np.maximum(np.maximum(ctx, pair), 1), 0.0)
    b = _bins(VALUE[cells >> 8 & 255])
    for _ in range(rounds):
        post = weight[b] * two / np.maximum(weight[b] * two + (1 - weight[b]) * uni, 1e-300)
        for i in range(1, len(weight)):
            if (b == i).any():
                weight[i] = min(0.95, max(0.001, float(np.average(post[b == i], weights=times[b == i]))))
    return weight


def probabilities(word: np.ndarray, pair: np.ndarray, context: np.ndarray, weight: np.ndarray, mass: int, types: int) -> np.ndarray:
    """P(w | c) by the levels of word and pair and the context's sum."""
    uni = (VALUE[word] + 0.1) / (mass + 0.1 * (types + 1))
    two = np.minimum(VALUE[pair] / np.maximum(context, 1), 1.0)
    w = weight[_bins(context)]
    return w * two + (1 - w) * np.minimum(uni, 1.0)


_PLACED = "ids array<long>, held array<boolean>, lens array<int>, packed binary"


def _place(key, table, answers):
    """A block's row with what its buckets have answered: counts, levels and sums of its words, levels of its tokens' pairs."""
    kinds = {c: table.schema.field(c).type for c in ("ids", "held", "lens")}
    schema = pa.schema([*kinds.items(), ("packed", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    rows = []
    answers = answers.sort_by("bucket")
    count, level, sums, pair_level = (_joined(answers.column(c), k)[0] for c, k in (("counts", np.int64), ("levels", np.uint8), ("sums", np.int64), ("pair_levels", np.uint8)))
    for _, _, lens, words, codes, place in _blocks(table.to_batches()):
        at, pair = _pairs(codes, lens, len(words))
        order = np.argsort(pair)
        new = np.append(True, pair[order][1:] != pair[order][:-1]) if len(pair) else np.zeros(0, bool)
        if (len(count), len(pair_level)) != (len(words), int(new.sum())):
            raise RuntimeError(f"a block of {len(words)} words and {int(new.sum())} pairs got {len(count)} and {len(pair_level)} answers")
        own = np.zeros(len(codes), np.uint8)
        own[at[order]] = pair_level[np.cumsum(new) - 1]
        ranks = np.argsort(place)
        rows.append(b"".join(_planes(x) for x in (ranks[codes], count[place], level[place], sums[place], own)))
    return pa.table([*(table.column(c) for c in kinds), pa.array(rows, pa.binary())], schema=schema)


def _placed(batches):
    """(ids, held, tokens by document, training counts, levels of words, sums of contexts, levels of pairs), all but the first three by token."""
    for b in batches:
        for i in range(len(b)):
            ids, held, lens = (b.column(c).slice(i, 1).flatten() for c in ("ids", "held", "lens"))
            blob, at, parts = b.column("packed")[i].as_py(), 0, []
            for _ in range(5):
                x, at = _unplaned(blob, at)
                parts.append(x.astype(np.int64))
            codes, count, level, sums, pair = parts
            lens = lens.to_numpy()
            context = np.roll(sums[codes], 1)
            context[np.cumsum(lens) - lens] = 0
            yield ids, held, lens, count[codes], level[codes], context, pair


def _cells(batches):
    """Counts of the level triples of the training rows."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, held, lens, _, word, context, pair in _placed(batches):
        use = np.repeat(~held.to_numpy(zero_copy_only=False), lens)
        k, c = np.unique((word << 16 | _levels(context) << 8 | pair)[use], return_counts=True)
        total = merged([total[0], k], [total[1], c])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in total], ["cell", "times"])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(weight: np.ndarray, n: int, types: int, mass: int):
    def run(batches):
        for ids, held, lens, count, word, context, pair in _placed(batches):
            p = np.log10(probabilities(word, pair, context, weight, mass, types))
            base = np.log10((count + 0.1) / (n + 0.1 * (types + 1)))
            by = lambda x: pa.array(np.add.reduceat(x, np.cumsum(lens) - lens))
            cols = [ids, held, pa.array(lens.astype(np.int64)), by((count > 0).astype(np.int64)), pa.array(np.full(len(lens), n, np.int64)), by(base), by(p)]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SCORED.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (tc.crc_mod("doc_id", 10) == 0).alias("held_out"))
    blocks, one = common.written(rows.mapInArrow(_tokenise(common.BLOCK_BYTES), _BLOCK))
    buckets = common.blocks_for(blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"], BUCKET_TOKENS)
    reduced, two = common.written(blocks.mapInArrow(_send(buckets), _SENT).groupBy("bucket").applyInArrow(_add_up(buckets), _REDUCED))
    total = reduced.where(F.col("block") == TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "mass")]).first()
    answers = reduced.where(F.col("block") != TOTALS).select(F.col("block").alias("to"), "bucket", "counts", "levels", "sums", "pair_levels")
    placed, _ = common.written(blocks.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_place, _PLACED))
    for folder in (one, two):
        common.removed(docs.sparkSession, folder)
    cells = placed.mapInArrow(_cells, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).orderBy("cell").collect()
    weight = tune_weights(*(np.array([r[c] for r in cells], np.int64) for c in ("cell", "times")), total["mass"], total["types"])
    return placed.mapInArrow(_scored(weight, total["tokens"], total["types"], total["mass"]), _SCORED)
