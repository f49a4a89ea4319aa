"""Quality rules with an isolation forest on rule statistics.

One pass gives each document its rule counts; a forest of random splits (`trees` trees on `psi`
rows each, Liu, Ting and Zhou 2008) is grown on the rule statistics of labelled good documents, and
a document whose average path is short stands apart from them. Each document's statistics are written
once; the box that the trees split and the threshold come from all labelled rows, one text a doc_id. A
tree's `psi` rows are the method's own random draw, here from trees * psi good rows chosen by a hash.
Anomaly scores are multiples of 1 / LEVELS, so the counts of labelled rows by score give the threshold:
the best balanced accuracy among those that keep `keep_good` of the good rows.

Defined cases: null text has no words (all counts 0, so it fails the base rule); labels without a
document, with a null or with another value are ignored; several labels of a doc_id count as the
lowest; without labelled rows the base rule alone decides; repeated rows are judged alike; other
columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

LEVELS = 1 << 16  # of the anomaly score
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIRST = np.ones(256, bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "sentence", "bangs", "distinct", "bars")


def _by_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) by document, over whole texts."""
    n = len(off) - 1
    starts, ends, ptr = tc.words(data, off)
    prefix = tc.prefix_hash(data)
    h = tc.span_hash(prefix, starts, ends)
    n_words = np.diff(ptr)
    chars = _by_doc(_FIRST[data] & ~tc.IS_SPACE[data], off)
    symbols = _by_doc(_SYMBOL[data], off)
    # Repeated three-word windows, by document.
    repeat = np.zeros(n, np.int64)
    distinct = np.zeros(n, np.int64)
    three = tc.grams(h, 3)
    for i in np.flatnonzero(n_words):
        a, b = ptr[i], ptr[i + 1]
        distinct[i] = len(np.unique(h[a:b]))
        if b - a >= 4:
            g = three[a : b - 2]
            order = np.argsort(g)
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                hit = np.zeros(len(g), bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                cover = np.zeros(b - a, bool)
                cover[:-2] |= hit
                cover[1:-1] |= hit
                cover[2:] |= hit
                repeat[i] = cover.sum()
    # Lines with a word that equal an earlier line.
    l_start, l_end, l_ptr = tc.runs(data != 10, off)
    word_at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~tc.IS_SPACE[data], out=word_at[1:])
    worded = word_at[l_end] > word_at[l_start]
    lh = tc.span_hash(prefix, l_start, l_end)
    dup = np.zeros(n, np.int64)
    lines = np.zeros(n, np.int64)
    for i in np.flatnonzero(np.diff(l_ptr)):
        own = lh[l_ptr[i] : l_ptr[i + 1]][worded[l_ptr[i] : l_ptr[i + 1]]]
        lines[i] = len(own)
        if len(own) > 1:
            dup[i] = len(own) - len(np.unique(own))
    base = np.stack([n_words, chars, symbols, dup, repeat], axis=1)
    size, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    upper, marks, digits = (_by_doc(x[data], off) for x in (_UPPER, _MARK, _DIGIT))
    stops, bangs, bars = _by_doc(_STOP[data], off), _by_doc(data == 33, off), _by_doc(data == 124, off)
    feats = np.stack([np.log1p(n_words), chars / w, symbols / size, dup / np.maximum(lines, 1), repeat / w, upper / size, marks / size, digits / size, np.log1p(n_words / (stops + 1)), bangs / size, distinct / w * np.log1p(n_words), bars / size], axis=1)
    return base, feats


def _depth(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    value: np.ndarray
    path: np.ndarray  # at leaves: depth, with the mean rest of the rows left there
    norm: float
    threshold: float = 1.0
    info: dict = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score 2^(-mean path / norm), in (0, 1], rounded up to a multiple of 1 / LEVELS."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, p in zip(self.feature, self.value, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                k = f[at]
                live = k >= 0
                if not live.any():
                    break
                right = x[rows[live], k[live]] >= v[at[live]]
                at[live] = 2 * at[live] + 1 + right
            total += p[at]
        return np.ceil(2.0 ** (-total / len(self.feature) / self.norm) * LEVELS) / LEVELS


def grow(x: np.ndarray, span: np.ndarray, trees: int = 100, psi: int = 256, limit: int = 10, seed: int = 3) -> Forest:
    """Trees over the cells of the box `span` (lowest and highest value by column).

    A split is a random place in the node's cell, not between its rows: a column that is constant on
    good documents splits too, so a document with a new value there falls into an empty cell at once.
    """
    rng = np.random.default_rng(seed)
    psi = min(psi, len(x))
    nodes = 2 ** (limit + 1) - 1
    usable = np.flatnonzero(span[1] > span[0])
    feature, value, path = np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        stack = [(0, x[rng.choice(len(x), psi, replace=False)], span[0].copy(), span[1].copy(), 0)]
        while stack:
            at, rows, low, high, depth = stack.pop()
            if depth >= limit or len(rows) <= 1 or not len(usable):
                path[t, at] = depth + _depth(len(rows))
                continue
            k = rng.choice(usable)
            cut = rng.uniform(low[k], high[k])
            side = rows[:, k] >= cut
            feature[t, at], value[t, at] = k, cut
            left_high, right_low = high.copy(), low.copy()
            left_high[k] = right_low[k] = cut
            stack += [(2 * at + 1, rows[~side], low, left_high, depth + 1), (2 * at + 2, rows[side], right_low, high, depth + 1)]
    return Forest(feature, value, path, _depth(psi) or 1.0)


def calibrate(forest: Forest, cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, keep_good: float) -> Forest:
    """The threshold from the numbers of good and bad rows at each score (in ascending order)."""
    kept, caught = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / max(1, bad.sum())
    if bad.sum():
        enough = np.flatnonzero(kept >= min(keep_good, kept[-1]))
        best = enough[np.argmax(kept[enough] + caught[enough])]  # the lowest of equals
    else:
        best = np.flatnonzero(good)[-1]
    forest.threshold = float(cuts[best])
    forest.info = {"good": int(good.sum()), "bad": int(bad.sum()), "good_kept": float(kept[best]), "bad_caught": float(caught[best]) if bad.sum() else 0.0}
    return forest


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


_MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, u long, x array<double>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, len(FEATURES)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, u, x) of every document: u a hash of the text, x the features."""

    def run(batches):
        for b in batches:
            base, x = np.zeros((len(b), 5), np.int64), np.zeros((len(b), len(FEATURES)))
            for a, z, data, off in tc.chunks(b.column("text")):
                base[a:z], x[a:z] = statistics(data, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(base[:, i]) for i in range(5)), pa.array(base_failed(base)), b.column("u"), _lists(x)], ["doc_id", *COUNTS, "base_failed", "u", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("u")).mapInArrow(run, _MEASURED)


def fit(stats: DataFrame, labels: DataFrame, keep_good: float = 0.995, trees: int = 100, psi: int = 256) -> Forest | None:
    """The forest with its threshold, from all labelled rows that the base rule leaves open."""
    given = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    one = stats.select("doc_id", "u", "base_failed", "x").join(given, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("u", "base_failed", "x")).alias("m"))
    rows, folder = common.written(one.where(~F.col("m.base_failed")).select("doc_id", F.col("quality").cast("int").alias("quality"), "m.x"))
    try:
        ends = [f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(len(FEATURES))]
        got = rows.agg(F.count_if(F.col("quality") == 1).alias("good"), *ends).first()
        if got["good"] < 8:
            return None
        span = np.array([[got[f"{name}{i}"] for i in range(len(FEATURES))] for name in ("low", "high")])
        order = F.xxhash64(F.lit("qual"), "doc_id")
        share = min(1.0, 1.1 * trees * psi / got["good"])
        pool = rows.where((F.col("quality") == 1) & (F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))).select(order.alias("order"), "x").toArrow().sort_by("order")
        forest = grow(_matrix(pool.column("x").combine_chunks()), span, trees, psi)
        shared = rows.sparkSession.sparkContext.broadcast(forest)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(shared.value.score(_matrix(b.column("x"))))], ["quality", "score"])

        seen = rows.select("quality", "x").mapInArrow(run, "quality int, score double").groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).toArrow().sort_by("score")
        return calibrate(forest, *(seen.column(c).to_numpy() for c in ("score", "good", "bad")), keep_good)
    finally:
        common.removed(rows.sparkSession, folder)


def quality(docs: DataFrame, labels: DataFrame, keep_good: float = 0.995) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, anomaly) of every document."""
    stats, _ = common.written(measured(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, keep_good))

    def run(batches):
        forest = shared.value
        for b in batches:
            anomaly = forest.score(_matrix(b.column("x"))) if forest is not None else np.zeros(len(b))
            failed = np.asarray(b.column("base_failed").to_numpy(zero_copy_only=False), bool)
            kept = ~failed & (anomaly <= (forest.threshold if forest else 1.0))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *COUNTS, "base_failed")] + [pa.array(kept), pa.array(anomaly)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return stats.drop("u").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")
